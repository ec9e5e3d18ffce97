"""What plans at larger sizes depend on."""

import operator

import pytest

from sparkloom.catalog import Graph
from sparkloom.operators import paths
from sparkloom.queries import knows
from sparkloom.session import Session
from sparkloom.storage import cut


def test_statistics_of_what_was_written(spark):
    """Exploded rows are more than Spark guesses, filtered ones fewer: joins with them are planned by what is there."""

    def size(df):
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    many = spark.range(1000).selectExpr("id", "explode(sequence(1L, 50L)) AS x")
    assert size(many) < 50_000 * 16 <= size(cut(many)) < 50_000 * 32
    assert size(cut(many.where("id < 0"))) < 100 and cut(many).count() == 50_000
    assert "Broadcast" not in spark.range(100_000_000).selectExpr("id AS x").join(cut(spark.range(40_000).selectExpr("id", "explode(sequence(1L, 30L)) AS x")), "x")._jdf.queryExecution().executedPlan().toString()


def test_files_are_as_large_as_their_rows(spark, tmp_path):
    """Columns that repeat take little room in a file: what is joined with a path's nodes is planned by its rows."""
    spark.range(200_000).selectExpr("id", "id div 2 AS up", "'the same' AS name").write.parquet(str(tmp_path / "part"))
    part = spark.read.parquet(str(tmp_path / "part"))
    factor, limit = "spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3000000")
    try:
        g = Graph(spark)
        g.add_nodes("part", part, "id")
        g.add_edges("parent", "part", "part", part.where("id > 0").selectExpr("id AS _src", "up AS _dst"))
        df = Session(g).execute("MATCH (a:part)-[p:parent*1..2]->(b:part) RETURN b.id AS b, length(p) AS n, properties(nodes(p), 'name') AS s")
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 199_999 + 199_998
    finally:
        spark.conf.set(limit, before)
        spark.conf.unset(factor)


def _most(df):
    """The most rows that a join of the plan that ran has made."""

    def most(plan):
        node = plan.nodeName()
        if node == "AdaptiveSparkPlan":
            return most(plan.executedPlan())
        found = [most(plan.children().apply(i)) for i in range(plan.children().size())] + ([most(plan.plan())] if "QueryStage" in node else [])
        rows = plan.metrics().get("numOutputRows")
        return max([*found, rows.get().value() if "Join" in node and rows.isDefined() else 0])

    return most(df._jdf.queryExecution().executedPlan())


def _friends(spark, edges):
    g = Graph(spark)
    g.add_nodes("person", spark.createDataFrame([(i,) for i in range(7)], "id long"), "id")
    g.add_edges("knows", "person", "person", spark.createDataFrame(edges, "_src long, _dst long"))
    return Session(g), [*edges, *[(d, s) for s, d in edges]]


def test_triangles_by_degree(spark):
    """Edges that are there twice, both ways or from a node to itself count as often as they are there, a closing edge that must be missing once."""
    s, both = _friends(spark, [(0, 1), (0, 1), (1, 0), (1, 2), (2, 0), (0, 3), (0, 4), (0, 5), (3, 4), (4, 5), (5, 5), (6, 6), (2, 3), (2, 3)])
    paths = [(a, b, d) for a, b in both for c, d in both if b == c]
    closed = sum(both.count((c, a)) for a, _, c in paths)
    assert s.execute("MATCH (a:person)-[:knows]-(b:person)-[:knows]-(c:person)-[:knows]-(a) RETURN count(*) AS n").first()[0] == closed
    open_ = "NOT EXISTS { MATCH (a)-[:knows]-(c) }"
    for where, kept in ((open_, lambda a, c: (a, c) not in both), (f"{open_} AND id(a) <> id(c)", lambda a, c: (a, c) not in both and a != c), ("id(a) <> id(c)", lambda a, c: a != c)):
        assert s.execute(f"MATCH (a:person)-[:knows]-(b:person)-[:knows]-(c:person) WHERE {where} RETURN count(*) AS n").first()[0] == sum(kept(a, c) for a, _, c in paths)


def test_hub_pairs_are_not_listed(spark):
    """A node that everybody knows: no join makes a row for each pair of those."""
    g = Graph(spark)
    g.add_nodes("person", spark.range(2001), "id")
    g.add_edges("knows", "person", "person", spark.range(1, 2001).selectExpr("id AS _src", "0L AS _dst"))
    text = "MATCH (a:person)-[:knows]-(b:person)-[:knows]-(c:person) WHERE NOT EXISTS { MATCH (a)-[:knows]-(c) } AND id(a) <> id(c) RETURN count(*) AS n"
    df = Session(g).execute(text)
    assert df.first()[0] == 2000 * 1999

    assert _most(df) < 100_000


def test_triangles_of_a_hub(spark):
    g = Graph(spark)
    g.add_nodes("person", spark.range(2001), "id")
    g.add_edges("knows", "person", "person", spark.range(1, 2001).selectExpr("id AS _src", "explode(array(0L, id % 2000 + 1)) AS _dst"))
    df = Session(g).execute("MATCH (a:person)-[:knows]-(b:person)-[:knows]-(c:person)-[:knows]-(a) RETURN count(*) AS n")
    assert df.first()[0] == 2000 * 6 and _most(df) < 100_000


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_ranges_are_counted(spark, op):
    """Nodes that are only counted within a range: equal values, doubles, nulls and keys of one side only, and no row a pair."""
    few, many = [(0, 1, 2.0), (1, 1, 5.0), (2, 2, 5.0), (3, None, 1.0), (4, 1, None), (5, 3, 0.0), (6, 1, 2.0)], [(i, i % 2 + 1, float(i % 7)) for i in range(3000)] + [(3000, None, 1.0), (3001, 1, None), (3002, 9, 1.0)]
    g = Graph(spark)
    g.add_nodes("few", spark.createDataFrame(few, "id long, k int, v double"), "id")
    g.add_nodes("many", spark.createDataFrame(many, "id long, k int, v double"), "id")
    df = Session(g).execute(f"MATCH (m:many), (f:few) WHERE m.k = f.k AND m.v {op} f.v RETURN f.id AS id, count(*) AS n")
    hold = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    wanted = {i: n for i, k, v in few if k and v is not None and (n := sum(y == k and z is not None and hold(z, v) for _, y, z in many))}
    assert {r.id: r.n for r in df.collect()} == wanted and _most(df) < 100


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_optional_ranges_are_counted(spark, op):
    """Optional nodes of which only the number is asked for, within a range: rows that find none stay, and no row is made for a pair."""
    few, many = [(0, 1, 2.0), (1, 1, 5.0), (2, 2, 5.0), (3, None, 1.0), (4, 1, None), (5, 3, 0.0), (6, 1, 2.0), *[(i, 1, 3.0) for i in range(10, 60)]], [(i, i % 2 + 1, float(i % 7)) for i in range(3000)] + [(3000, None, 1.0), (3001, 1, None), (3002, 9, 1.0)]
    g = Graph(spark)
    g.add_nodes("few", spark.createDataFrame(few, "id long, k int, v double"), "id")
    g.add_nodes("many", spark.createDataFrame(many, "id long, k int, v double"), "id")
    g.add_nodes("at", spark.range(4), "id")
    g.add_edges("few_at", "few", "at", spark.createDataFrame([(i, k) for i, k, _ in few if k], "_src long, _dst long"))
    g.add_edges("many_at", "many", "at", spark.createDataFrame([(i, k) for i, k, _ in many if k and k < 4], "_src long, _dst long"))
    hold = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    wanted = {i: sum(y == k and z is not None and v is not None and hold(z, v) for _, y, z in many) for i, k, v in few if k}
    text = f"MATCH (f:few)-[:few_at]->(a:at) OPTIONAL MATCH (m:many)-[:many_at]->(a) WHERE m.v {op} f.v RETURN f.id AS id, count(m) AS n, count(*) AS rows"
    df = Session(g).execute(text)
    assert {r.id: (r.n, r.rows) for r in df.collect()} == {i: (n, max(n, 1)) for i, n in wanted.items()} and _most(df) < 4000
    # what is read of the nodes themselves needs them
    found = Session(g).execute(text.replace("count(m) AS n", "count(m) AS n, max(m.id) AS most, count(DISTINCT m) AS d")).collect()
    assert {r.id: (r.n, r.d, r.rows) for r in found} == {i: (n, n, max(n, 1)) for i, n in wanted.items()}


def test_counted_ranges_hold_nan(spark):
    """NaN stands above all numbers, whether pairs are made or only counted."""
    values = [(i, 1, v) for i, v in enumerate([float("nan"), 0.0, -0.0, float("inf"), 1.0, None])]
    g = Graph(spark)
    g.add_nodes("few", spark.createDataFrame(values, "id long, k int, v double"), "id")
    g.add_nodes("many", spark.createDataFrame(values, "id long, k int, v double"), "id")
    g.add_nodes("at", spark.range(2), "id")
    for kind, label in (("few_at", "few"), ("many_at", "many")):
        g.add_edges(kind, label, "at", spark.range(6).selectExpr("id AS _src", "1L AS _dst"))
    found = Session(g).execute("MATCH (f:few)-[:few_at]->(a:at) OPTIONAL MATCH (m:many)-[:many_at]->(a) WHERE m.v >= f.v RETURN f.id AS id, count(m) AS n").collect()
    assert {r.id: r.n for r in found} == {0: 1, 1: 5, 2: 5, 3: 2, 4: 3, 5: 0}
    found = Session(g).execute("MATCH (m:many), (f:few) WHERE m.k = f.k AND m.v >= f.v RETURN f.id AS id, count(*) AS n").collect()
    assert {r.id: r.n for r in found} == {0: 1, 1: 5, 2: 5, 3: 2, 4: 3}


def test_rounds_broadcast_no_pairs(spark, monkeypatch):
    """Joins by start and end, a round each: Spark takes 64 MB for a broadcast of several keys."""
    plans = []
    whole = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df))[1])
    s, _ = _friends(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)])
    assert s.execute("MATCH (a:person {id: 0})-[p:knows*SHORTEST 1..6]->(b:person) RETURN count(*) AS n").first()[0] == 4
    assert sum("LeftAnti" in p for p in plans) > 1 and not any("BroadcastHashJoin" in x and "LeftAnti" in x for p in plans for x in p.splitlines())


def _broadcast(plan):
    """The columns of what a plan broadcasts."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _broadcast(plan.executedPlan())
    own = {plan.output().apply(i).name() for i in range(plan.output().size())} if plan.nodeName() == "BroadcastExchange" else set()
    return own.union(*[_broadcast(plan.children().apply(i)) for i in range(plan.children().size())])


def test_cheapest_paths_broadcast_no_edges(spark, monkeypatch):
    """Three edges a node, made by an explode that Spark takes for one: no round sends them through the driver."""
    rounds, whole = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (rounds.append(_broadcast(df._jdf.queryExecution().executedPlan())), whole(df))[1])
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "200000")
    try:
        people = spark.range(4000).withColumnRenamed("id", "c_custkey")
        g = Graph(spark)
        g.add_nodes("customer", people, "c_custkey")
        g.add_edges("knows", "customer", "customer", cut(knows(people)))
        assert Session(g).execute("MATCH (a:customer {c_custkey: 0})-[p:knows*WSHORTEST(w)]->(b:customer) RETURN b.c_custkey AS b, cost(p) AS c").count() == 3999
        assert len(rounds) > 10 and not any("near" in c for sent in rounds for c in sent)
    finally:
        spark.conf.set(limit, before)
