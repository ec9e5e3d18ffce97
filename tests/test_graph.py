"""Statements on a graph of six nodes whose answers are known."""

import pytest

from sparkloom.catalog import CatalogFault, Graph
from sparkloom.plans.frame import BindFault
from sparkloom.session import Session
from sparkloom.types import Interval, parse_interval


def modern(spark):
    s = Session(Graph(spark))
    s.load_builtin_dataset("modern_graph")
    return s


@pytest.fixture(scope="module")
def s(spark):
    return modern(spark)


def rows(session, text, **parameters):
    return [tuple(r) for r in session.execute(text, parameters).collect()]


def test_pattern_predicate(s):
    text = "MATCH (a:person)-[:created]->(s)<-[:created]-(c:person) WHERE {} (a)-[:knows]->(c) AND a <> c RETURN count(*)"
    assert rows(s, text.format("NOT")) == [(5,)]
    assert rows(s, text.format("")) == [(1,)]


def test_weighted_shortest(s):
    assert rows(s, "MATCH (a:person {name: 'marko'})-[e* WSHORTEST(weight)]-(b:person {name: 'josh'}) RETURN cost(e), length(e)") == [(0.8, 2)]
    assert rows(s, "MATCH (a:person {name: 'marko'})-[e:knows* WSHORTEST(weight)]-(b:person {name: 'josh'}) RETURN cost(e), length(e)") == [(1.0, 1)]


def test_collect_after_order(s):
    assert rows(s, "MATCH (a) WITH a ORDER BY a.name WITH labels(a) AS l, collect(a.name)[0] AS f RETURN l, f ORDER BY l") == [("person", "josh"), ("software", "lop")]


def test_missing_property_is_null(s):
    assert rows(s, "MATCH (a) WHERE a.age IS NULL RETURN a.name ORDER BY a.name") == [("lop",), ("ripple",)]


def test_homomorphism_and_undirected(s):
    assert rows(s, "MATCH (a:person)-[:knows]-(b)-[:knows]-(c) RETURN count(*)") == [(6,)]
    assert rows(s, "MATCH (a:person)-[:knows*TRAIL 2..2]-(c) RETURN count(*)") == [(2,)]
    assert rows(s, "MATCH (a:person)-[:knows*ACYCLIC 2..2]-(c) RETURN count(*)") == [(2,)]
    assert rows(s, "MATCH (a:person)-[:knows*2]-(c) RETURN count(*)") == [(6,)]


def test_optional(s):
    assert rows(s, "MATCH (a:person) OPTIONAL MATCH (a)-[c:created]->(s:software) WHERE c.weight > 0.3 RETURN a.name, s.name ORDER BY a.name, s.name") == [("josh", "lop"), ("josh", "ripple"), ("marko", "lop"), ("peter", None), ("vadas", None)]
    assert rows(s, "MATCH (a:person) OPTIONAL MATCH (a)-[:knows]->(b) MATCH (b)-[:created]->(c) RETURN count(*)") == [(2,)]


def test_shortest_leaves_out_the_start(s):
    assert rows(s, "MATCH (a:person {id: $i})-[k:knows*SHORTEST 1..3]-(f:person) RETURN f.name, length(k) ORDER BY f.name", i=2) == [("josh", 2), ("marko", 1)]


def test_path_values(s):
    (found,) = rows(s, "MATCH p = (a:person {id: 1})-[:knows]->(b {id: 2}) RETURN p")[0]
    assert [n["name"] for n in found["nodes"]] == ["marko", "vadas"]
    assert (found["length"], found["rels"][0]["weight"]) == (1, 0.5)
    assert rows(s, "MATCH (a:person {id: 1})-[e:knows*ALL SHORTEST 1..]->(b:person) UNWIND rels(e) AS r WITH START_NODE(r) AS x, b MATCH (x:person)-[:created]->(s) RETURN b.name, s.name ORDER BY b.name") == [("josh", "lop"), ("vadas", "lop")]


def test_integer_division_and_temporal(s):
    assert rows(s, "RETURN 7 / 2, -7 / 2, -7 % 3, 7 / 2.0") == [(3, -3, -1, 3.5)]
    assert rows(s, "RETURN CAST(date('1900-01-01') + interval('3 years 2 days') AS STRING), CAST(date('1900-01-01') - interval('3 years 3 days') AS STRING)") == [("1903-01-03", "1896-12-29")]
    assert rows(s, "RETURN interval('30 days') = interval('1 month'), CAST(timestamp('2020-01-02 00:00:00') - timestamp('2019-01-02 00:00:00') AS STRING)") == [(True, "8760 hours")]
    assert rows(s, "RETURN date_part('month', interval('14 months')), 1.0 / 0 > 1000") == [(2, True)]


def test_null_in_list(s):
    assert rows(s, "RETURN 1 IN [1, NULL], 2 IN [1, NULL], NULL IN [1]") == [(True, False, None)]


def test_with_needs_names(s):
    with pytest.raises(BindFault):
        s.execute("MATCH (a:person) WITH a.name RETURN 1")
    with pytest.raises(BindFault):
        s.execute("MATCH (a:person) RETURN a.nothing")
    with pytest.raises(CatalogFault):
        s.execute("MATCH (a:nobody) RETURN a")
    with pytest.raises(BindFault):
        s.execute("MATCH (a:software)-[:knows]->(b) RETURN a")
    with pytest.raises(BindFault):
        s.execute("MATCH (a:person) RETURN a.name ORDER BY a")
    with pytest.raises(BindFault):
        s.execute("MATCH (a:person) RETURN a.name LIMIT -1")


def test_parameters_and_functions(s):
    import datetime as dt

    from pyspark.sql import functions as F

    s.register("twice", lambda c: c * 2)
    assert rows(s, "MATCH (a:person) WHERE a.id IN $ids RETURN twice(a.age) ORDER BY a.id", ids=[1, 6]) == [(58,), (70,)]
    assert rows(s, "RETURN $d < date('2021-01-01')", d=dt.date(2020, 1, 1)) == [(True,)]
    assert F is not None


def test_updates(spark):
    s = modern(spark)
    s.execute("CREATE (p:person {id: 9, name: 'zoe', age: 5})")
    s.execute("MATCH (a:person {id: 9}), (b:person {id: 1}) CREATE (a)-[:knows {weight: 0.7}]->(b)")
    assert rows(s, "MATCH (a:person {id: 9}) SET a.age = a.age + 1 RETURN a.age, a.name") == [(6, "zoe")]
    s.execute("MATCH (a)-[k:knows]->(b) WHERE a.id = 1 SET k.weight = k.weight * 2")
    assert sorted(rows(s, "MATCH (a:person)-[k:knows]->() RETURN a.id, k.weight")) == [(1, 1.0), (1, 2.0), (9, 0.7)]
    with pytest.raises(BindFault):
        s.execute("MATCH (a:person {id: 9}) DELETE a")
    with pytest.raises(BindFault):
        s.execute("CREATE (p:person {id: 9, name: 'again'})")
    with pytest.raises(BindFault):
        s.execute("MATCH (a:person {id: 9}) SET a.id = 10")
    s.execute("MATCH (a:person {id: 9})-[k:knows]->() DELETE k")
    s.execute("MATCH (a:person {id: 9}) DELETE a")
    s.execute("MATCH (a:person {id: 1}) DETACH DELETE a")
    assert rows(s, "MATCH (a:person) RETURN count(*)") == [(3,)]
    assert rows(s, "MATCH ()-[k]->() RETURN count(*)") == [(3,)]
    assert rows(s, "MERGE (a:person {id: 2}) ON MATCH SET a.age = 1 ON CREATE SET a.age = 2 RETURN a.age") == [(1,)]
    assert rows(s, "MERGE (a:person {id: 3}) ON MATCH SET a.age = 1 ON CREATE SET a.age = 2 RETURN a.age") == [(2,)]


def test_definitions(spark, tmp_path):
    s = Session.open(spark, str(tmp_path / "db"))
    s.execute("CREATE NODE TABLE p (id INT64, name STRING, PRIMARY KEY (id))")
    s.execute("CREATE NODE TABLE IF NOT EXISTS p (id INT64, PRIMARY KEY (id))")
    with pytest.raises(CatalogFault):
        s.execute("CREATE NODE TABLE p (id INT64, PRIMARY KEY (id))")
    s.execute("CREATE REL TABLE k (FROM p TO p, w DOUBLE)")
    with pytest.raises(CatalogFault):
        s.execute("DROP TABLE p")
    (tmp_path / "p.csv").write_text("id,name\n1,a\n2,\n2,twice\n")
    (tmp_path / "k.csv").write_text("a,b,w\n1,2,0.5\n1,7,1.0\n")
    s.execute(f"COPY p FROM '{tmp_path}/p.csv' (header=true, delim=',')")
    s.execute(f"COPY k FROM '{tmp_path}/k.csv' (header=true, delim=',')")
    assert sorted(rows(s, "MATCH (a:p) RETURN a.id, a.name"))[0] == (1, "a")
    assert rows(s, "MATCH (a:p) RETURN count(*)") == [(2,)]
    assert rows(s, "MATCH (a:p)-[e:k]->(b) RETURN a.id, b.id, e.w") == [(1, 2, 0.5)]
    s.execute("ALTER TABLE p ADD city STRING DEFAULT 'x'")
    s.execute("ALTER TABLE p RENAME city TO town")
    s.execute("ALTER TABLE p RENAME TO q")
    s.execute("CHECKPOINT")
    again = Session.open(spark, str(tmp_path / "db"))
    assert rows(again, "MATCH (a:q)-[:k]->(b) RETURN a.town, b.id") == [("x", 2)]
    again.execute("DROP TABLE k")
    again.execute("DROP TABLE q")
    again.execute("DROP TABLE IF EXISTS q")
    assert again.graph.nodes == {}


def test_files_without_a_schema(spark, tmp_path):
    s = Session(Graph(spark))
    (tmp_path / "u.json").write_text('[{"id": 1, "n": "a"}, {"id": 2, "n": "b"}]')
    (tmp_path / "e.jsonl").write_text('{"a": 1, "b": 2, "w": 3}\n')
    s.execute(f"COPY u FROM '{tmp_path}/u.json'")
    s.execute(f"COPY f FROM '{tmp_path}/e.jsonl' (from='u', to='u')")
    assert rows(s, "MATCH (a:u)-[e:f]->(b:u) RETURN a.n, e.w, b.n") == [("a", 3, "b")]
    assert rows(s, f"LOAD FROM '{tmp_path}/u.json' WHERE id > 1 RETURN n") == [("b",)]
    (tmp_path / "n.csv").write_text("5|x\n6|y\n")
    assert rows(s, f"LOAD WITH HEADERS (a INT64, b STRING) FROM '{tmp_path}/n.csv' (header=false) WHERE a > 5 RETURN b, a + 1") == [("y", 7)]
    s.execute(f"COPY (MATCH (a:u)-[e:f]->(b) RETURN a, e.w AS w) TO '{tmp_path}/out.json'")
    assert rows(s, f"LOAD FROM '{tmp_path}/out.json' RETURN w, a.n") == [(3, "a")]
    s.execute(f"COPY (MATCH (a:u {{id: 1}}) RETURN a) TO '{tmp_path}/out.csv' (header=true)")
    assert '"n":"a"' in rows(s, f"LOAD FROM '{tmp_path}/out.csv' (header=true) RETURN a")[0][0]


def test_bulk_loader(spark, tmp_path):
    from sparkloom.sources.bulk import load_graph

    prop = lambda name, kind: {"property_name": name, "property_type": kind}
    schema = {"schema": {
        "vertex_types": [{"type_name": "p", "properties": [prop("id", {"primitive_type": "DT_SIGNED_INT64"}), prop("name", {"string": {"long_text": None}}), prop("job", {"temporal": {"interval": None}})], "primary_keys": ["id"]}],
        "edge_types": [{"type_name": "k", "vertex_type_pair_relations": [{"source_vertex": "p", "destination_vertex": "p", "relation": "MANY_TO_MANY"}], "properties": [prop("w", {"primitive_type": "DT_DOUBLE"})]}],
    }}
    (tmp_path / "p.csv").write_text("id|name|job\n1|a|2 days 3 hours\n2|b|\n")
    (tmp_path / "k.csv").write_text("x|y|w\n1|2|0.5\n2|9|1.5\n")
    column = lambda i, name: {"column": {"index": i, "name": name}, "property": name}
    mapping = {"loading_config": {"format": {"metadata": {"delimiter": "|"}}}, "vertex_mappings": [{"type_name": "p", "inputs": ["p.csv"], "column_mappings": [column(0, "id"), column(1, "name"), column(2, "job")]}], "edge_mappings": [{"type_triplet": {"edge": "k", "source_vertex": "p", "destination_vertex": "p"}, "inputs": ["k.csv"], "column_mappings": [column(2, "w")]}]}
    s = Session(load_graph(spark, schema, mapping, str(tmp_path)))
    assert rows(s, "MATCH (a:p)-[e:k]->(b) RETURN a.name, e.w, b.name") == [("a", 0.5, "b")]
    assert rows(s, "MATCH (a:p {id: 1}) WHERE a.job > interval('2 days') RETURN CAST(a.job AS STRING)") == [("2 days 3 hours",)]


def test_star_hides_what_has_no_name(s):
    df = s.execute("MATCH (a:person {id: 1})-[:knows]->(in_b:person)-[sub:created]->() WHERE EXISTS { MATCH (in_b)-[:created]->() } RETURN *")
    assert df.columns == ["a", "in_b", "sub"]


def test_named_variable_length_path(s):
    (p,) = rows(s, "MATCH p = (a:person {id: 1})-[:knows*1..1]->(b {id: 4}) RETURN p")[0]
    assert [n["name"] for n in p["nodes"]] == ["marko", "josh"] and len(p["rels"]) == p["length"] == 1
    assert rows(s, "MATCH p = (a:person {id: 1})-[e*2..2]->(b:software) RETURN properties(nodes(p), 'name'), properties(rels(e), 'weight') ORDER BY b.name") == [(["marko", "josh", "lop"], [1.0, 0.4]), (["marko", "josh", "ripple"], [1.0, 1.0])]
    assert rows(s, "MATCH (a:person)-[e:knows*1..2]-(a) RETURN count(*)") == [(4,)]


def test_lists_and_casts(s):
    assert rows(s, "RETURN list_sort([3, 1, 2], 'DESC'), list_sort([3, 1]), CAST('[1, 2]', 'INT64[]'), [1, 2, 3][-2:], list_transform([1, 2], x -> x * 2)") == [([3, 2, 1], [1, 3], [1, 2], [2, 3], [2, 4])]
    assert rows(s, "UNWIND [interval('29 days'), interval('1 month'), interval('31 days')] AS i RETURN CAST(i AS STRING) AS t ORDER BY i DESC") == [("31 days",), ("1 month",), ("29 days",)]
    assert rows(s, "MATCH (a:person) RETURN a.id ORDER BY a.id SKIP 1 + 1 LIMIT 0 + 1") == [(4,)]
    assert rows(s, "MATCH (a:person) WITH a.age AS s, a.name AS n MATCH (b:person) WHERE s = b.age AND n <> 'josh' RETURN n, b.name, s ORDER BY s LIMIT 1") == [("vadas", "vadas", 27)]


def test_keys_of_different_types(spark):
    g = Graph(spark)
    g.add_nodes("n", spark.createDataFrame([(1, "x")], "id int, v string"), "id")
    g.add_nodes("m", spark.createDataFrame([("a", 2)], "name string, w int"), "name")
    g.add_edges("e", "n", "m", spark.createDataFrame([(1, "a")], "_src int, _dst string"))
    g.add_edges("f", "m", "n", spark.createDataFrame([("a", 1)], "_src string, _dst int"))
    s = Session(g)
    assert rows(s, "MATCH (x:n)-[:e]->(y)-[:f]->(z) RETURN x = z, id(x) = id(z), z.v") == [(True, True, "x")]
    assert rows(s, "MATCH (x)-[p*2..2]->(y:n) RETURN x.id, length(p), size(nodes(p))") == [(1, 2, 3)]
    assert rows(s, "MATCH (x:n {id: 1})-[p*SHORTEST 1..]->(y) RETURN y.name, length(p)") == [("a", 1)]
    assert rows(s, "MATCH (x) OPTIONAL MATCH (x)-[:e]->(y:m) WHERE EXISTS { MATCH (y)-[:f]->(x) } RETURN label(x), y.name ORDER BY label(x)") == [("m", None), ("n", "a")]
    assert rows(s, "MATCH (x:n {id: 1})-[:e]->(y) RETURN x.v, y.name, y.w, x.id + 1") == [("x", "a", 2, 2)]
    assert rows(s, "MATCH (x) RETURN label(x), x.id, x.name ORDER BY label(x)") == [("m", None, "a"), ("n", 1, None)]


def test_builder_is_the_text(s):
    from sparkloom.builder import query
    from sparkloom.cypher.parser import parse

    people = query().match("(a:person)-[k:knows]->(b:person)")
    built = people.where("a.age > $least").where("k.weight > 0.6").with_("b").returns("b.name AS n", "b.age AS age").order_by("age DESC", "n").skip(0).limit(3)
    text = "MATCH (a:person)-[k:knows]->(b:person) WHERE a.age > $least AND k.weight > 0.6 WITH b RETURN b.name AS n, b.age AS age ORDER BY age DESC, n SKIP 0 LIMIT 3"
    assert [tuple(r) for r in s.run(built.build(), {"least": 20}).collect()] == rows(s, text, least=20) == [("josh", 32)]
    both = people.returns("a.name AS n").union(query().match("(x:software)").optional_match("(x)<-[:created]-(y:person)").returns("y.name AS n", distinct=True))
    assert both.build().union_all == parse("RETURN 1 UNION RETURN 2").union_all
    assert {tuple(r) for r in s.run(both.build()).collect()} == {("marko",), ("josh",), ("peter",)}


def test_search_ends_at_its_targets(spark, monkeypatch):
    """A line of a hundred nodes: a target two hops away ends the search there."""
    from sparkloom.operators import paths

    g = Graph(spark)
    g.add_nodes("n", spark.range(100), "id")
    g.add_edges("e", "n", "n", spark.range(99).selectExpr("id AS _src", "id + 1 AS _dst"))
    hops = []
    monkeypatch.setattr(paths.Paths, "hop", lambda self, *a, f=paths.Paths.hop, **k: (hops.append(1), f(self, *a, **k))[1])
    s = Session(g)
    assert rows(s, "MATCH (a:n {id: 3})-[p:e*SHORTEST 1..]->(b:n {id: 5}) RETURN length(p)") == [(2,)]
    assert rows(s, "MATCH (a:n), (b:n) WHERE a.id IN [1, 7] AND b.id = a.id + 3 MATCH (a)-[p:e*SHORTEST 1..]->(b) RETURN a.id, length(p) ORDER BY a.id") == [(1, 3), (7, 3)]
    assert len(hops) == 5


def test_settings(spark):
    s = modern(spark)
    text = "MATCH (a:person)-[:knows*2..2]-(c) RETURN count(*)"
    assert rows(s, text) == [(6,)]
    s.execute("CALL recursive_pattern_semantic = 'trail'")
    assert rows(s, text) == [(2,)]
    s.execute("CALL var_length_extend_max_depth = 1")
    with pytest.raises(BindFault):
        s.execute(text)


def test_walks_and_trails_of_a_clique(spark):
    """Four people who all know each other: 27 walks and 24 trails of three steps from one of them, 9 walks of two."""
    g = Graph(spark)
    g.add_nodes("person", spark.range(4).withColumnRenamed("id", "ID"), "ID")
    g.add_edges("knows", "person", "person", spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a != b], "_src long, _dst long"))
    s = Session(g)
    count = lambda r: rows(s, f"MATCH (a:person)-[e:knows*{r}]->(b:person) WHERE a.ID = 0 RETURN count(*)")[0][0]
    assert (count("3..3"), count("2..2"), count("TRAIL 3..3"), count("ACYCLIC 3..3"), count("5")) == (27, 9, 24, 6, 243)


def test_counts_are_summed_early(spark, sf_dir):
    """A chain whose middle is not read is summed hop by hop, and the counts stay the same."""
    from sparkloom.queries import graph

    s = Session(graph(spark, sf_dir))
    chain = "MATCH (a:customer)-[:knows]->(b:customer)-[:knows]->(c:customer)-[:knows]->(d:customer) "
    whole = rows(s, chain + "RETURN a.c_custkey AS x, b.c_custkey AS y, c.c_custkey AS z, d.c_custkey AS w")
    assert rows(s, chain + "RETURN count(*)") == [(len(whole),)]
    assert sorted(rows(s, chain + "RETURN d.c_custkey, count(*), min(d.c_acctbal) IS NULL")) == sorted((k, sum(r[3] == k for r in whole), False) for k in {r[3] for r in whole})
    assert rows(s, chain + "WHERE a.c_custkey < d.c_custkey RETURN count(*), count(DISTINCT d)") == [(sum(r[0] < r[3] for r in whole), len({r[3] for r in whole if r[0] < r[3]}))]
    assert rows(s, chain + "MATCH (d)-[:lives_in]->(n:nation) OPTIONAL MATCH (d)-[:placed]->(o:orders) WHERE o.o_orderstatus = 'P' RETURN count(o)") == rows(s, chain + "MATCH (d)-[:lives_in]->(n:nation) OPTIONAL MATCH (d)-[:placed]->(o:orders) WHERE o.o_orderstatus = 'P' WITH a, b, c, d, o RETURN count(o)")


def test_pushdown(spark, sf_dir):
    plan = Session(Graph(spark)).execute(f"EXPLAIN LOAD FROM '{sf_dir}/orders.parquet' WHERE o_totalprice > 1000.0 RETURN o_orderkey").first()[0]
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_neighbours_are_joined_only_for_their_properties(spark, sf_dir):
    from sparkloom.queries import graph

    plan = Session(graph(spark, sf_dir)).execute("EXPLAIN MATCH (:customer)-[:placed]->(o:orders)-[:contains]->(p:part) RETURN o.o_orderkey, p.p_partkey").first()[0]
    assert "part.parquet" not in plan and plan.count("Join") <= 4 * 2


def test_intervals():
    assert parse_interval("1year2months3days4hours5minutes6seconds") == Interval(14, 3, 14_706_000_000)
    with pytest.raises(ValueError):
        parse_interval("3 apples")


def test_checkpoints_of_a_reopened_store(spark, tmp_path):
    """Tables that are read from the store are checkpointed there again and again; what was read from the version before still can be."""
    path = str(tmp_path / "store")
    s = Session.open(spark, path)
    s.execute("CREATE NODE TABLE p (id INT64, PRIMARY KEY (id))")
    s.execute("CREATE REL TABLE k (FROM p TO p)")
    for i in range(4):
        s.execute(f"CREATE (a:p {{id: {i}}})-[:k]->(b:p {{id: {100 + i}}})")
        s.execute("CHECKPOINT")
        before = s.execute("MATCH (a:p)-[:k]->(b) RETURN a.id, b.id")
        s.execute("CHECKPOINT")
        assert before.count() == i + 1
        s = Session.open(spark, path)
        assert sorted(rows(s, "MATCH (a:p)-[:k]->(b) RETURN a.id, b.id")) == [(j, 100 + j) for j in range(i + 1)]
    assert len([x for x in (tmp_path / "store").iterdir() if not x.name.startswith(".")]) == 2
    s = Session.open(spark, path)
    s.execute("CREATE (a:p {id: 50})")  # not checkpointed
    assert rows(Session.open(spark, path), "MATCH (a:p) RETURN count(*)") == [(8,)]


def weighted(spark, edges):
    g = Graph(spark)
    g.add_nodes("n", spark.range(6), "id")
    g.add_edges("e", "n", "n", spark.createDataFrame(edges, "_src long, _dst long, w double"))
    return Session(g)


def test_edges_without_a_weight_are_no_way(spark):
    s = weighted(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, None), (0, 3, float("nan")), (2, 3, 4.0)])
    assert rows(s, "MATCH (a:n {id: 0})-[p:e*WSHORTEST(w)]->(b:n) RETURN b.id, cost(p), length(p) ORDER BY b.id") == [(1, 1.0, 1), (2, 2.0, 2), (3, 6.0, 3)]
    assert rows(weighted(spark, [(0, 1, None)]), "MATCH (a:n {id: 0})-[p:e*WSHORTEST(w)]->(b:n) RETURN b.id, cost(p)") == []


def test_weights_of_zero_and_below(spark):
    cycle = [(0, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 3, 1.0), (1, 3, 1.0), (0, 3, 1.0)]
    s = weighted(spark, cycle)
    assert rows(s, "MATCH (a:n {id: 0})-[p:e*WSHORTEST(w)]->(b:n) RETURN b.id, cost(p) ORDER BY b.id") == [(1, 0.0), (2, 0.0), (3, 1.0)]
    assert rows(s, "MATCH (a:n {id: 0})-[p:e*ALL WSHORTEST(w)]->(b:n) RETURN b.id, cost(p), count(*) ORDER BY b.id") == [(1, 0.0, 1), (2, 0.0, 1), (3, 1.0, 3)]
    with pytest.raises(ValueError, match="not negative"):
        weighted(spark, [(0, 1, 1.0), (1, 0, -2.0)]).execute("MATCH (a:n {id: 0})-[p:e*WSHORTEST(w)]->(b:n) RETURN cost(p)")


def test_weighted_search_ends_at_its_targets(spark, monkeypatch):
    from sparkloom.operators import paths

    g = Graph(spark)
    g.add_nodes("n", spark.range(100), "id")
    g.add_edges("e", "n", "n", spark.range(99).selectExpr("id AS _src", "id + 1 AS _dst", "1.0D AS w"))
    hops = []
    monkeypatch.setattr(paths.Paths, "hop", lambda self, *a, f=paths.Paths.hop, **k: (hops.append(1), f(self, *a, **k))[1])
    s = Session(g)
    assert rows(s, "MATCH (a:n {id: 3})-[p:e*WSHORTEST(w)]->(b:n {id: 6}) RETURN cost(p)") == [(3.0,)]
    assert rows(s, "MATCH (a:n {id: 3})-[p:e*WSHORTEST(w)]->(b:n) WHERE b.id IN [5, 7] RETURN b.id, cost(p) ORDER BY b.id") == [(5, 2.0), (7, 4.0)]
    assert len(hops) <= 8


def test_many_small_changes(spark):
    """Changes are kept beside the table and folded in after a while."""
    s = modern(spark)
    for i in range(20):
        s.execute(f"CREATE (p:person {{id: {100 + i}, name: 'p', age: {i}}})")
    s.execute("MATCH (a:person) WHERE a.id >= 110 SET a.age = a.age + 100")
    s.execute("MATCH (a:person) WHERE a.id >= 115 DELETE a")
    assert rows(s, "MATCH (a:person) WHERE a.id >= 100 RETURN count(*), sum(a.age)") == [(15, sum(range(10)) + sum(100 + i for i in range(10, 15)))]


def test_copied_rows_of_one_key(spark, tmp_path):
    """Of new rows with one key the least stays, whatever the order of the files; those that are there stay as they are."""
    s = Session(Graph(spark))
    s.execute("CREATE NODE TABLE p (id INT64, name STRING, PRIMARY KEY (id))")
    (tmp_path / "a.csv").write_text("id,name\n1,z\n1,b\n2,c\n")
    (tmp_path / "b.csv").write_text("id,name\n1,a\n2,a\n3,q\n3,p\n")
    s.execute(f"COPY p FROM '{tmp_path}/a.csv' (header=true, delim=',')")
    s.execute(f"COPY p FROM '{tmp_path}/b.csv' (header=true, delim=',')")
    assert sorted(rows(s, "MATCH (a:p) RETURN a.id, a.name")) == [(1, "b"), (2, "c"), (3, "p")]


def test_written_files(spark, s, tmp_path):
    import json

    s.execute(f"COPY (MATCH (a:person) RETURN a.id AS id, a.name AS name) TO '{tmp_path}/out.json'")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out.json").glob("part-*")]
    assert sorted(r["id"] for part in parts for r in part) == [1, 2, 4, 6]
    assert rows(s, f"LOAD FROM '{tmp_path}/out.json' RETURN count(*)") == [(4,)]
    with pytest.raises(FileExistsError):
        s.execute(f"COPY (MATCH (a:person) RETURN a.id AS id) TO '{tmp_path}/out.json' (overwrite = false)")
    s.execute(f"COPY (MATCH (a:person) WHERE a.id > 10 RETURN a.id AS id) TO '{tmp_path}/none.json'")
    assert [x for p in (tmp_path / "none.json").glob("part-*") for x in json.loads(p.read_text())] == []


def test_degrees_are_multiplied(spark):
    """Leaves of a star that nothing reads are counted, also both ways and over several types."""
    g = Graph(spark)
    g.add_nodes("n", spark.range(6), "id")
    e = [(0, 1), (0, 2), (0, 2), (1, 2), (3, 0)]
    g.add_edges("e", "n", "n", spark.createDataFrame(e, "_src long, _dst long"))
    g.add_edges("f", "n", "n", spark.createDataFrame([(0, 4), (2, 5)], "_src long, _dst long"))
    s = Session(g)
    out = lambda k, es: [b for a, b in es if a == k]
    f = [(0, 4), (2, 5)]
    assert rows(s, "MATCH (a:n)-[:e]->(b:n), (a)-[:f]->(c:n), (a)<-[:e]-(d:n) RETURN count(*)") == [(sum(len(out(k, e)) * len(out(k, f)) * sum(b == k for _, b in e) for k in range(6)),)]
    both = e + [(b, a) for a, b in e] + f + [(b, a) for a, b in f]
    assert rows(s, "MATCH (a:n)-[:f]->(b:n), (a)-[]-(c:n) RETURN b.id, count(*) ORDER BY b.id") == [(b, len(out(a, both))) for a, b in f]


def test_walks_whose_start_is_not_read(spark):
    """Counts of walks from all nodes, from several rows a node, with lengths, and with what goes on from their ends."""
    g = Graph(spark)
    e = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (3, 3), (4, 0)]
    g.add_nodes("n", spark.range(6), "id")
    g.add_edges("e", "n", "n", spark.createDataFrame(e, "_src long, _dst long"))
    s = Session(g)
    step = lambda ks: [b for k in ks for a, b in e if a == k]
    levels = [list(range(6))]
    for _ in range(5):
        levels.append(step(levels[-1]))
    assert rows(s, "MATCH (a:n)-[:e*5]->(b:n) RETURN count(*)") == [(len(levels[5]),)]
    assert rows(s, "MATCH (a:n)-[p:e*0..4]->(b:n) RETURN length(p), count(*) ORDER BY length(p)") == [(k, len(levels[k])) for k in range(5)]
    assert rows(s, "MATCH (a:n)-[:e*1..2]->(b:n) RETURN b.id, count(*) ORDER BY b.id") == [(k, (levels[1] + levels[2]).count(k)) for k in range(6) if k in levels[1] + levels[2]]
    assert rows(s, "MATCH (x:n)-[:e]->(a:n)-[:e*2]->(b:n)-[:e]->(c:n) RETURN count(*)") == [(len(levels[4]),)]
    assert rows(s, "MATCH (a:n)-[:e*2]->(b:n) WHERE a.id > 1 AND b.id < 3 RETURN count(*)") == [(sum(k < 3 for k in step(step([2, 3, 4, 5]))),)]
    assert rows(s, "MATCH (a:n)-[:e*2]->(b:n) WHERE a.id < b.id RETURN count(*)") == [(sum(a < b for a in range(6) for b in step(step([a]))),)]
    assert rows(s, "MATCH (a:n)-[:e*2]->(b:n) RETURN a.id, count(*) ORDER BY a.id") == [(a, len(step(step([a])))) for a in range(5)]
