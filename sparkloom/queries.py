"""Queries over the driver's tables as a property graph, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Graph
from .session import Session
from .storage import cut, shared_folder

_graphs: dict[tuple[str, str], Graph] = {}


def knows(customers: DataFrame) -> DataFrame:
    """A derived graph among customers: each knows the next, the one after it and (7 c + 3) mod n."""
    n = customers.count()
    pairs = customers.select(F.col("c_custkey").alias("_src"), F.explode(F.array((F.col("c_custkey") + 1) % n, (F.col("c_custkey") + 2) % n, (7 * F.col("c_custkey") + 3) % n)).alias("_dst"))
    return pairs.where("_src <> _dst").distinct().withColumn("w", ((31 * F.col("_src") + 17 * F.col("_dst")) % 10 + 1).cast("double"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables in sf_dir as nodes and edges; the derived edges are made once and kept in the shared folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at in _graphs:
        return _graphs[at]
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in "region nation customer supplier part orders lineitem events documents".split()}
    g = Graph(spark)
    for label, table, key in (("customer", "customer", "c_custkey"), ("orders", "orders", "o_orderkey"), ("part", "part", "p_partkey"), ("supplier", "supplier", "s_suppkey"), ("nation", "nation", "n_nationkey"), ("region", "region", "r_regionkey"), ("event", "events", "event_id")):
        g.add_nodes(label, t[table], key)
    g.add_nodes("document", t["documents"].select("doc_id", "lang", "source", "n_chars"), "doc_id")
    g.add_nodes("person", t["events"].select("user_id").distinct(), "user_id")
    lines = t["lineitem"]

    def ends(df: DataFrame, src: str, dst: str, *props: str) -> DataFrame:
        return df.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), *props)

    g.add_edges("placed", "customer", "orders", ends(t["orders"], "o_custkey", "o_orderkey", "o_orderdate"))
    g.add_edges("contains", "orders", "part", ends(lines, "l_orderkey", "l_partkey", *[c for c in lines.columns if c not in ("l_orderkey", "l_partkey")]))
    g.add_edges("shipped_by", "orders", "supplier", ends(lines, "l_orderkey", "l_suppkey", "l_quantity", "l_shipdate"))
    g.add_edges("lives_in", "customer", "nation", ends(t["customer"], "c_custkey", "c_nationkey"))
    g.add_edges("based_in", "supplier", "nation", ends(t["supplier"], "s_suppkey", "s_nationkey"))
    g.add_edges("in_region", "nation", "region", ends(t["nation"], "n_nationkey", "n_regionkey"))
    g.add_edges("did", "person", "event", ends(t["events"], "user_id", "event_id"))
    shared_folder(spark)
    g.add_edges("knows", "customer", "customer", cut(knows(t["customer"])))
    g.add_edges("parent", "part", "part", t["part"].where("p_partkey > 0").select(F.col("p_partkey").alias("_src"), F.expr("p_partkey div 2").alias("_dst")))
    a, b = t["nation"].alias("a"), t["nation"].alias("b")
    g.add_edges("same_region", "nation", "nation", a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("_src"), F.col("b.n_nationkey").alias("_dst")))
    _graphs[at] = g
    return g


_KNOWS = """k0 AS (SELECT c_custkey AS c, (SELECT count(*) FROM customer) AS n FROM customer),
knows AS (SELECT DISTINCT c AS src, d AS dst, CAST((31 * c + 17 * d) % 10 + 1 AS DOUBLE) AS w FROM (SELECT c, unnest([(c + 1) % n, (c + 2) % n, (7 * c + 3) % n]) AS d FROM k0) WHERE c <> d)"""
_BOTH = _KNOWS + ", both_ways AS (SELECT src, dst, w, src * 1000000 + dst AS e FROM knows UNION ALL SELECT dst, src, w, src * 1000000 + dst FROM knows)"

#: name -> (query, parameters, SQL)
TEXTS: dict[str, tuple[str, dict, str]] = {}


def _q(name: str, text: str, sql: str, **parameters) -> None:
    TEXTS[name] = (text, parameters, sql)


# scans and projections
_q("flagship_customers_by_nation", "MATCH (c:customer)-[:lives_in]->(n:nation) WHERE c.c_acctbal > $least RETURN n.n_name AS nation, count(*) AS cnt, round(sum(c.c_acctbal), 2) AS total ORDER BY cnt DESC, nation",
   "SELECT n_name AS nation, count(*) AS cnt, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 GROUP BY n_name", least=1000)
_q("scan_filter", "MATCH (o:orders) WHERE o.o_totalprice > 300000 AND o.o_orderstatus = 'F' RETURN o.o_orderkey AS k, o.o_totalprice AS p",
   "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
_q("scan_special_pred", "MATCH (p:part) WHERE p.p_size < $s RETURN p.p_partkey AS k, p.p_size AS s", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size < 5", s=5)
_q("scan_pk", "MATCH (c:customer {c_custkey: $k}) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42", k=42)
_q("scan_multi_label", "MATCH (n:customer:supplier) RETURN label(n) AS l, n.c_name AS c, n.s_name AS s, n.c_acctbal IS NULL AS miss",
   "SELECT 'customer' AS l, c_name AS c, NULL AS s, false AS miss FROM customer UNION ALL SELECT 'supplier', NULL, s_name, true FROM supplier")
_q("scan_any_label", "MATCH (n) WHERE n.n_name IS NOT NULL OR n.r_name IS NOT NULL RETURN label(n) AS l, count(*) AS c", "SELECT 'nation' AS l, count(*) AS c FROM nation UNION ALL SELECT 'region', count(*) FROM region")
_q("dummy_source", "RETURN 1 + 1 AS two, 'x' AS x, true AND NOT false AS t", "SELECT 2 AS two, 'x' AS x, true AS t")
_q("project_arith", "MATCH (p:part) RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, round(p.p_retailprice / 3, 4) AS b, -p.p_size AS c, p.p_size ^ 2 AS d", "SELECT p_partkey AS k, p_size * 2 + 1 AS a, round(p_retailprice / 3, 4) AS b, -p_size AS c, CAST(p_size AS DOUBLE) * p_size AS d FROM part")
_q("project_intdiv_mod", "MATCH (p:part) RETURN p.p_partkey AS k, p.p_size / 7 AS q, p.p_size % 7 AS r, (0 - p.p_size) / 7 AS nq, (0 - p.p_size) % 7 AS nr",
   "SELECT p_partkey AS k, p_size // 7 AS q, p_size % 7 AS r, CAST(trunc(-p_size / 7.0) AS BIGINT) AS nq, -(p_size % 7) AS nr FROM part")
_q("case_when", "MATCH (o:orders) RETURN o.o_orderkey AS k, CASE WHEN o.o_totalprice > 250000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code",
   "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
_q("cast_matrix", "MATCH (p:part) RETURN p.p_partkey AS k, CAST(p.p_size AS STRING) AS s, CAST(p.p_size AS DOUBLE) AS d, CAST(CAST(p.p_size AS STRING) AS INT64) AS i, CAST(p.p_size, 'INT32') AS j, CAST(p.p_size > 10 AS BOOL) AS b",
   "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS BIGINT) AS i, p_size AS j, p_size > 10 AS b FROM part")
_q("string_preds", "MATCH (p:part) WHERE p.p_type STARTS WITH 'S' OR p.p_type ENDS WITH 'R' OR p.p_name CONTAINS 'e' RETURN p.p_partkey AS k, p.p_type STARTS WITH 'S' AS a, p.p_type ENDS WITH 'R' AS b, p.p_name CONTAINS 'e' AS c, p.p_name =~ '.*[0-9]+' AS d",
   "SELECT p_partkey AS k, starts_with(p_type, 'S') AS a, ends_with(p_type, 'R') AS b, contains(p_name, 'e') AS c, regexp_full_match(p_name, '.*[0-9]+') AS d FROM part WHERE starts_with(p_type, 'S') OR ends_with(p_type, 'R') OR contains(p_name, 'e')")
_q("upper_lower_reverse", "MATCH (n:nation) RETURN n.n_nationkey AS k, upper(n.n_name) AS u, lower(n.n_name) AS l, reverse(n.n_name) AS r, concat(n.n_name, '!') AS c, size(n.n_name) AS s, substring(n.n_name, 2, 3) AS m",
   "SELECT n_nationkey AS k, upper(n_name) AS u, lower(n_name) AS l, reverse(n_name) AS r, n_name || '!' AS c, length(n_name) AS s, substr(n_name, 2, 3) AS m FROM nation")
_q("in_list", "MATCH (c:customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] AND NOT c.c_nationkey IN [1, 2, 3] RETURN c.c_custkey AS k, c.c_mktsegment AS m", "SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
_q("null_logic", "MATCH (n:customer:supplier) WHERE n.c_acctbal > 0 OR n.s_acctbal > 5000 RETURN label(n) AS l, n.c_acctbal > 0 AND false AS f, n.c_acctbal > 0 OR true AS t, n.s_acctbal IS NULL AS nu, count(*) AS c",
   "WITH u AS (SELECT 'customer' AS l, c_acctbal AS c, NULL AS s FROM customer UNION ALL SELECT 'supplier', NULL, s_acctbal FROM supplier) SELECT l, (c > 0 AND false) AS f, (c > 0 OR true) AS t, s IS NULL AS nu, count(*) AS c FROM u WHERE c > 0 OR s > 5000 GROUP BY ALL")
_q("bool_xor", "MATCH (p:part) RETURN p.p_partkey AS k, (p.p_size > 10) XOR (p.p_retailprice > 1000) AS x", "SELECT p_partkey AS k, (p_size > 10) <> (p_retailprice > 1000) AS x FROM part")
_q("list_functions", "MATCH (n:nation) WITH n, [n.n_nationkey, n.n_regionkey, 7] AS l RETURN n.n_nationkey AS k, l[0] AS a, l[1:3] AS b, size(l) AS c, 7 IN l AS d, any(x IN l WHERE x > 20) AS e, all(x IN l WHERE x >= 0) AS f",
   "SELECT n_nationkey AS k, n_nationkey AS a, [n_regionkey, 7] AS b, 3 AS c, true AS d, n_nationkey > 20 AS e, true AS f FROM nation")
_q("date_part_all", "MATCH (o:orders) RETURN o.o_orderkey AS k, date_part('year', o.o_orderdate) AS y, date_part('month', o.o_orderdate) AS m, date_part('day', o.o_orderdate) AS d, date_part('hour', o.o_orderdate) AS h, date_part('minute', o.o_orderdate) AS mi, date_part('second', o.o_orderdate) AS s",
   "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders")
_q("date_minus_date", "MATCH (o:orders) RETURN o.o_orderkey AS k, CAST(o.o_orderdate - timestamp('1992-01-01 00:00:00') AS INT64) AS ms", "SELECT o_orderkey AS k, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1992-01-01') AS ms FROM orders")
_q("ts_plus_interval", "MATCH (o:orders) RETURN o.o_orderkey AS k, o.o_orderdate + interval('1 month 3 days 2 hours') AS t, o.o_orderdate - interval('2 days') AS b", "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 3 DAY AS TIMESTAMP) + (o_orderdate - CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + INTERVAL 2 HOUR AS t, o_orderdate - INTERVAL 2 DAY AS b FROM orders")
_q("interval_compare", "MATCH (o:orders) WHERE o.o_orderdate - timestamp('1995-01-01 00:00:00') > interval('1 year') RETURN count(*) AS c", "SELECT count(*) AS c FROM orders WHERE epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') > CAST(360 AS BIGINT) * 86400000")
_q("star_properties", "MATCH (r:region) RETURN r.*", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region')

# traversal
_q("expand_out", "MATCH (c:customer)-[:placed]->(o:orders) RETURN c.c_custkey AS c, o.o_orderkey AS o, o.o_totalprice AS p", "SELECT o_custkey AS c, o_orderkey AS o, o_totalprice AS p FROM orders")
_q("expand_in", "MATCH (o:orders)<-[:placed]-(c:customer) WHERE o.o_totalprice > 200000 RETURN o.o_orderkey AS o, c.c_name AS c", "SELECT o_orderkey AS o, c_name AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000")
_q("expand_both", "MATCH (a:customer)-[:knows]-(b:customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"WITH {_BOTH} SELECT src AS a, dst AS b FROM both_ways")
_q("expand_edge_props", "MATCH (o:orders)-[l:contains]->(p:part) RETURN o.o_orderkey AS o, p.p_name AS p, l.l_quantity AS q, l.l_discount AS d", "SELECT l_orderkey AS o, p_name AS p, l_quantity AS q, l_discount AS d FROM lineitem JOIN part ON l_partkey = p_partkey")
_q("expand_edge_pred", "MATCH (o:orders)-[l:contains]->(p:part) WHERE l.l_quantity > 45 AND l.l_returnflag = 'R' RETURN p.p_brand AS b, count(*) AS c, round(sum(l.l_extendedprice), 2) AS s", "SELECT p_brand AS b, count(*) AS c, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND l_returnflag = 'R' GROUP BY 1")
_q("expand_nbr_pred", "MATCH (c:customer)-[:lives_in]->(n:nation {n_name: $n}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)", n="__first_nation")
_q("expand_multi_type", "MATCH (a)-[e:lives_in|based_in]->(n:nation) RETURN label(a) AS a, label(e) AS e, n.n_name AS n, count(*) AS c", "SELECT 'customer' AS a, 'lives_in' AS e, n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 'supplier', 'based_in', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_q("expand_untyped", "MATCH (a)-[e]->(r:region) RETURN label(a) AS a, label(e) AS e, r.r_name AS r, count(*) AS c", "SELECT 'nation' AS a, 'in_region' AS e, r_name AS r, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_q("expand_degree", "MATCH (c:customer)-[:placed]->(o:orders) RETURN c.c_custkey AS c, count(o) AS d", "SELECT o_custkey AS c, count(*) AS d FROM orders GROUP BY 1")
_q("expand_count", "MATCH (o:orders)-[:contains]->(p:part) RETURN count(*) AS c", "SELECT count(*) AS c FROM lineitem")
_q("get_v_endpoints", "MATCH (a:customer)-[k:knows]->(b:customer) RETURN start_node(k)._ID = id(a) AS s, end_node(k)._ID = id(b) AS e, count(*) AS c", f"WITH {_KNOWS} SELECT true AS s, true AS e, count(*) AS c FROM knows")
_q("two_hop", "MATCH (r:region)<-[:in_region]-(n:nation)<-[:lives_in]-(c:customer) RETURN r.r_name AS r, count(*) AS c, round(avg(c.c_acctbal), 4) AS a", "SELECT r_name AS r, count(*) AS c, round(avg(c_acctbal), 4) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q("three_hop", "MATCH (n:nation)<-[:lives_in]-(c:customer)-[:placed]->(o:orders)-[l:contains]->(p:part) WHERE p.p_size = 15 RETURN n.n_name AS n, count(*) AS c, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS rev",
   "SELECT n_name AS n, count(*) AS c, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 15 GROUP BY 1")
_q("chain_count", "MATCH (:region)<-[:in_region]-(:nation)<-[:lives_in]-(:customer)-[:placed]->(:orders)-[:contains]->(:part)-[:parent]->(:part) RETURN count(*) AS c", "SELECT count(*) AS c FROM lineitem WHERE l_partkey > 0")
_q("star_count", "MATCH (s:supplier)<-[:shipped_by]-(o:orders)<-[:placed]-(c:customer), (o)-[:contains]->(p:part) RETURN count(*) AS c", "SELECT sum(n * n) AS c FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
_q("triangle_count", "MATCH (a:customer)-[:knows]->(b:customer)-[:knows]->(c:customer), (a)-[:knows]->(c) RETURN count(*) AS c", f"WITH {_KNOWS} SELECT count(*) AS c FROM knows x JOIN knows y ON x.dst = y.src JOIN knows z ON z.src = x.src AND z.dst = y.dst")
_q("cycle3_count", "MATCH (a:customer)-[:knows]->(b:customer)-[:knows]->(c:customer)-[:knows]->(a) RETURN count(*) AS c", f"WITH {_KNOWS} SELECT count(*) AS c FROM knows x JOIN knows y ON x.dst = y.src JOIN knows z ON z.src = y.dst AND z.dst = x.src")
_q("square_count", "MATCH (a:customer)-[:knows]->(b:customer)-[:knows]->(d:customer), (a)-[:knows]->(c:customer)-[:knows]->(d) WHERE id(b) <> id(c) RETURN count(*) AS c", f"WITH {_KNOWS} SELECT count(*) AS c FROM knows w JOIN knows x ON w.dst = x.src JOIN knows y ON y.src = w.src JOIN knows z ON z.src = y.dst AND z.dst = x.dst WHERE w.dst <> y.dst")
_q("clique4_count", "MATCH (a:nation)-[:same_region]->(b:nation)-[:same_region]->(c:nation)-[:same_region]->(d:nation), (a)-[:same_region]->(c), (a)-[:same_region]->(d), (b)-[:same_region]->(d) RETURN count(*) AS c",
   "WITH s AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) SELECT count(*) AS c FROM s ab JOIN s bc ON ab.y = bc.x JOIN s cd ON bc.y = cd.x JOIN s ac ON ac.x = ab.x AND ac.y = bc.y JOIN s ad ON ad.x = ab.x AND ad.y = cd.y JOIN s bd ON bd.x = ab.y AND bd.y = cd.y")
_q("intersect_with_edge", "MATCH (a:customer)-[e:knows]->(b:customer), (a)-[f:knows]->(c:customer), (b)-[g:knows]->(c) WHERE e.w > 3 RETURN a.c_custkey AS a, b.c_custkey AS b, c.c_custkey AS c, e.w + f.w + g.w AS w", f"WITH {_KNOWS} SELECT e.src AS a, e.dst AS b, f.dst AS c, e.w + f.w + g.w AS w FROM knows e JOIN knows f ON f.src = e.src JOIN knows g ON g.src = e.dst AND g.dst = f.dst WHERE e.w > 3")
_q("self_loop", "MATCH (p:part)-[:parent]->(p) RETURN count(*) AS c", "SELECT count(*) AS c FROM part WHERE p_partkey > 0 AND p_partkey // 2 = p_partkey")
_q("common_neighbour", "MATCH (a:customer {c_custkey: 5})-[:knows]-(x:customer)-[:knows]-(b:customer) WHERE a <> b RETURN b.c_custkey AS b, count(DISTINCT x) AS n", f"WITH {_BOTH} SELECT y.dst AS b, count(DISTINCT x.dst) AS n FROM both_ways x JOIN both_ways y ON x.dst = y.src WHERE x.src = 5 AND y.dst <> 5 GROUP BY 1")

# optional, exists, joins
_q("optional_expand", "MATCH (c:customer) OPTIONAL MATCH (c)-[:placed]->(o:orders) WHERE o.o_totalprice > 250000 RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1")
_q("optional_corr", "MATCH (c:customer)-[:lives_in]->(n:nation) OPTIONAL MATCH (s:supplier)-[:based_in]->(n) WHERE s.s_acctbal > c.c_acctbal RETURN c.c_custkey AS c, count(s) AS n", "SELECT c_custkey AS c, count(s_suppkey) AS n FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal GROUP BY 1")
_q("optional_uncorr", "MATCH (r:region) OPTIONAL MATCH (p:part) WHERE p.p_size > 1000 RETURN r.r_name AS r, p.p_name AS p", "SELECT r_name AS r, CAST(NULL AS VARCHAR) AS p FROM region")
_q("optional_chain", "MATCH (c:customer) OPTIONAL MATCH (c)-[:placed]->(o:orders) WHERE o.o_orderstatus = 'P' OPTIONAL MATCH (o)-[l:contains]->(p:part) WHERE l.l_quantity > 40 RETURN c.c_custkey AS c, o.o_orderkey AS o, p.p_partkey AS p", "SELECT c_custkey AS c, o_orderkey AS o, l_partkey AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40")
_q("optional_start", "OPTIONAL MATCH (c:customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, count(c) AS m", "SELECT 1 AS n, 0 AS m")
_q("exists_pattern", "MATCH (c:customer) WHERE EXISTS { MATCH (c)-[:placed]->(o:orders) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_q("not_exists_pattern", "MATCH (p:part) WHERE NOT EXISTS { MATCH (o:orders)-[l:contains]->(p) WHERE l.l_quantity > 49 } RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
_q("pattern_predicate", "MATCH (a:customer)-[:knows]->(b:customer)-[:knows]->(c:customer) WHERE NOT (a)-[:knows]->(c) AND id(a) <> id(c) RETURN count(*) AS c", f"WITH {_KNOWS} SELECT count(*) AS c FROM knows x JOIN knows y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM knows z WHERE z.src = x.src AND z.dst = y.dst)")
_q("exists_in_expression", "MATCH (c:customer) WHERE c.c_acctbal > 9000 OR (c)-[:placed]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_q("count_subquery", "MATCH (n:nation) RETURN n.n_name AS n, COUNT { MATCH (c:customer)-[:lives_in]->(n) WHERE c.c_acctbal > 9990 } AS c", "SELECT n_name AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990) AS c FROM nation")
_q("join_value_eq", "MATCH (c:customer), (s:supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal RETURN s.s_suppkey AS s, count(*) AS c", "SELECT s_suppkey AS s, count(*) AS c FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1")
_q("cross_product", "MATCH (r:region), (n:nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
_q("pk_join", "MATCH (e:event) MATCH (c:customer {c_custkey: e.user_id}) RETURN e.event_id AS e, c.c_name AS c", "SELECT event_id AS e, c_name AS c FROM events JOIN customer ON c_custkey = user_id")
_q("multi_match", "MATCH (c:customer)-[:lives_in]->(n:nation) MATCH (n)-[:in_region]->(r:region) MATCH (c)-[:placed]->(o:orders) RETURN r.r_name AS r, count(*) AS c", "SELECT r_name AS r, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q("join_hint", "MATCH (c:customer)-[e:lives_in]->(n:nation)-[f:in_region]->(r:region) HINT (r JOIN f) JOIN e RETURN r.r_name AS r, count(*) AS c", "SELECT r_name AS r, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")

# paths
_WALK = "WITH RECURSIVE {edges}, w AS (SELECT src AS s, src AS t, 0 AS n, [src] AS vs, [0::BIGINT] AS es FROM (SELECT DISTINCT src FROM both_ways) UNION ALL SELECT w.s, k.dst, n + 1, list_append(vs, k.dst), list_append(es, k.e) FROM w JOIN {table} k ON k.src = w.t WHERE n < {hops}{test})"
_q("walk_1_3", "MATCH (a:customer)-[:knows*1..3]->(b:customer) RETURN a.c_custkey AS a, b.c_custkey AS b", _WALK.format(edges=_BOTH + ", fwd AS (SELECT src, dst, w, src * 1000000 + dst AS e FROM knows)", table="fwd", hops=3, test="") + " SELECT s AS a, t AS b FROM w WHERE n >= 1")
_q("walk_lengths", "MATCH (a:customer)-[p:knows*0..4]->(b:customer) RETURN length(p) AS n, count(*) AS c", _WALK.format(edges=_BOTH + ", fwd AS (SELECT src, dst, w, src * 1000000 + dst AS e FROM knows)", table="fwd", hops=4, test="") + " SELECT n, count(*) AS c FROM w GROUP BY 1")
_q("trail_1_3", "MATCH (a:customer)-[p:knows*TRAIL 1..3]-(b:customer) RETURN length(p) AS n, b.c_custkey AS b, count(*) AS c", _WALK.format(edges=_BOTH, table="both_ways", hops=3, test=" AND NOT list_contains(es, k.e)") + " SELECT n, t AS b, count(*) AS c FROM w WHERE n >= 1 GROUP BY ALL")
_q("acyclic_1_3", "MATCH (a:customer)-[p:knows*ACYCLIC 1..3]-(b:customer) RETURN length(p) AS n, b.c_custkey AS b, count(*) AS c", _WALK.format(edges=_BOTH, table="both_ways", hops=3, test=" AND NOT list_contains(vs, k.dst)") + " SELECT n, t AS b, count(*) AS c FROM w WHERE n >= 1 GROUP BY ALL")
def _steps(test: str = "true") -> str:
    """SQL of the number of walks of 0 to 9 steps that end at each customer, from those that pass the test."""
    return _KNOWS + f", s0 AS (SELECT c_custkey AS c, 1 AS n FROM customer WHERE {test})" + "".join(f", s{i} AS (SELECT dst AS c, CAST(sum(n) AS BIGINT) AS n FROM s{i - 1} JOIN knows ON src = c GROUP BY dst)" for i in range(1, 10))


_q("walk_count_8", "MATCH (a:customer)-[:knows*8]->(b:customer) RETURN count(*) AS c", f"WITH {_steps()} SELECT CAST(sum(n) AS BIGINT) AS c FROM s8")
_q("long_chain_count", "MATCH (a:customer)" + "".join(f"-[:knows]->(x{i}:customer)" for i in range(9)) + "-[:lives_in]->(n:nation) RETURN n.n_name AS n, count(*) AS c", f"WITH {_steps()} SELECT n_name AS n, CAST(sum(s9.n) AS BIGINT) AS c FROM s9 JOIN customer ON c_custkey = s9.c JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_q("walk_edge_pred", "MATCH (a:customer)-[p:knows*1..3 (r, n | WHERE r.w > 4)]->(b:customer) RETURN length(p) AS n, count(*) AS c", _WALK.format(edges=_BOTH + ", fwd AS (SELECT src, dst, w, src * 1000000 + dst AS e FROM knows WHERE w > 4)", table="fwd", hops=3, test="") + " SELECT n, count(*) AS c FROM w WHERE n >= 1 GROUP BY 1")
_q("path_nodes_rels", "MATCH (a:part)-[p:parent*1..3]->(b:part) RETURN a.p_partkey AS a, b.p_partkey AS b, length(p) AS n, properties(nodes(p), 'p_size') AS s, size(rels(p)) AS r, is_acyclic(p) AS ac",
   "WITH RECURSIVE w AS (SELECT p_partkey AS a, p_partkey AS b, 0 AS n, [p_size] AS s, [p_partkey] AS vs FROM part UNION ALL SELECT a, q.p_partkey, n + 1, list_append(s, q.p_size), list_append(vs, q.p_partkey) FROM w JOIN part q ON q.p_partkey = w.b // 2 WHERE w.b > 0 AND n < 3) SELECT a, b, n, s, n AS r, len(list_distinct(vs)) = len(vs) AS ac FROM w WHERE n >= 1")
_q("path_unbounded", "MATCH (a:part)-[p:parent*1..]->(b:part {p_partkey: 1}) RETURN length(p) AS n, count(*) AS c", "WITH RECURSIVE w AS (SELECT p_partkey AS b, 0 AS n FROM part UNION ALL SELECT b // 2, n + 1 FROM w WHERE b > 0) SELECT n, count(*) AS c FROM w WHERE b = 1 AND n >= 1 GROUP BY 1")
_q("named_path", "MATCH p = (c:customer)-[:lives_in]->(n:nation)-[:in_region]->(r:region) RETURN c.c_custkey AS c, length(p) AS n, properties(nodes(p), 'r_name')[2] AS r", "SELECT c_custkey AS c, 2 AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_BFS = "WITH RECURSIVE {edges}, w AS (SELECT src AS s, src AS t, 0 AS n FROM (SELECT DISTINCT src FROM {table} WHERE src = {start}) UNION SELECT w.s, k.dst, n + 1 FROM w JOIN {table} k ON k.src = w.t WHERE n < {hops}), d AS (SELECT s, t, min(n) AS n FROM w GROUP BY ALL)"
_q("any_shortest_len", "MATCH (a:customer {c_custkey: 0})-[p:knows*SHORTEST 1..6]->(b:customer) RETURN b.c_custkey AS b, length(p) AS n", _BFS.format(edges=_KNOWS, table="knows", start=0, hops=6) + " SELECT t AS b, n FROM d WHERE s <> t")
_q("shortest_target", "MATCH (a:customer {c_custkey: 3})-[p:knows*SHORTEST 1..8]-(b:customer {c_custkey: 77}) RETURN length(p) AS n, size(nodes(p)) AS v", _BFS.format(edges=_BOTH, table="both_ways", start=3, hops=8) + " SELECT n, n + 1 AS v FROM d WHERE s = 3 AND t = 77")
_q("shortest_filter_limit", "MATCH (a:customer {c_custkey: 3})-[p:knows*SHORTEST 1..5]-(b:customer) WHERE b.c_acctbal > 5000 RETURN b.c_custkey AS b, length(p) AS n ORDER BY n, b LIMIT 20", _BFS.format(edges=_BOTH, table="both_ways", start=3, hops=5) + " SELECT t AS b, n FROM d JOIN customer ON c_custkey = t WHERE s = 3 AND t <> 3 AND c_acctbal > 5000 ORDER BY n, b LIMIT 20")
_q("all_shortest_count", "MATCH (a:customer)-[p:knows*ALL SHORTEST 1..4]->(b:customer) RETURN a.c_custkey AS a, b.c_custkey AS b, length(p) AS n, count(*) AS c",
   f"WITH RECURSIVE {_KNOWS}, w AS (SELECT c_custkey AS s, c_custkey AS t, 0 AS n FROM customer UNION ALL SELECT w.s, k.dst, n + 1 FROM w JOIN knows k ON k.src = w.t WHERE n < 4), m AS (SELECT s, t, n, count(*) AS c FROM w GROUP BY ALL) SELECT s AS a, t AS b, n, c FROM m WHERE s <> t AND n = (SELECT min(n) FROM m x WHERE x.s = m.s AND x.t = m.t)")
_q("weighted_shortest_cost", "MATCH (a:customer {c_custkey: 0})-[p:knows*WSHORTEST(w)]->(b:customer) RETURN b.c_custkey AS b, cost(p) AS c", f"WITH RECURSIVE {_KNOWS}, w AS (SELECT 0::BIGINT AS t, 0::DOUBLE AS c UNION SELECT k.dst, w.c + k.w FROM w JOIN knows k ON k.src = w.t WHERE w.c + k.w <= 60) SELECT t AS b, min(c) AS c FROM w WHERE t > 0 GROUP BY 1")

# aggregation, order, sets
_q("agg_group", "MATCH (o:orders)-[l:contains]->(:part) RETURN l.l_returnflag AS f, l.l_linestatus AS s, sum(l.l_quantity) AS q, round(avg(l.l_extendedprice), 4) AS a, min(l.l_discount) AS mi, max(l.l_tax) AS ma, count(*) AS c", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS mi, max(l_tax) AS ma, count(*) AS c FROM lineitem GROUP BY 1, 2")
_q("agg_keyless", "MATCH (o:orders) WHERE o.o_totalprice < 0 RETURN count(*) AS c, sum(o.o_totalprice) AS s, max(o.o_orderkey) AS m", "SELECT count(*) AS c, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_totalprice < 0")
_q("agg_distinct", "MATCH (c:customer)-[:placed]->(o:orders) RETURN c.c_mktsegment AS m, count(DISTINCT c) AS c, count(DISTINCT o.o_orderpriority) AS p", "SELECT c_mktsegment AS m, count(DISTINCT c_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_q("agg_pair_distinct", "MATCH (o:orders)-[l:contains]->(p:part) RETURN count(DISTINCT l.l_returnflag, l.l_linenumber) AS c", "SELECT count(*) AS c FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)")
_q("agg_expression", "MATCH (c:customer) RETURN c.c_nationkey % 5 AS g, sum(c.c_acctbal) / count(*) > 4500 AS rich, count(*) * 2 AS d", "SELECT c_nationkey % 5 AS g, sum(c_acctbal) / count(*) > 4500 AS rich, count(*) * 2 AS d FROM customer GROUP BY 1")
_q("collect_list_sorted", "MATCH (n:nation)-[:in_region]->(r:region) WITH r, n ORDER BY n.n_name DESC WITH r.r_name AS r, collect(n.n_name) AS names RETURN r, names, names[0] AS last", "SELECT r_name AS r, list(n_name ORDER BY n_name DESC) AS names, max(n_name) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q("collect_set_sorted", "MATCH (c:customer)-[:lives_in]->(n:nation) RETURN n.n_name AS n, collect(DISTINCT c.c_mktsegment) AS m", "SELECT n_name AS n, list_sort(list(DISTINCT c_mktsegment)) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_q("group_null_key", "MATCH (n:customer:supplier) RETURN n.c_mktsegment AS m, count(*) AS c", "SELECT c_mktsegment AS m, count(*) AS c FROM customer GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM supplier")
_q("group_by_node", "MATCH (c:customer)-[:placed]->(o:orders) WITH c, count(o) AS n, max(o.o_totalprice) AS p WHERE n > 12 RETURN c.c_name AS c, n, p", "SELECT c_name AS c, count(*) AS n, max(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12")
_q("distinct_multi", "MATCH (o:orders) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
_q("distinct_node", "MATCH (c:customer)-[:placed]->(o:orders) WHERE o.o_totalprice > 350000 WITH DISTINCT c RETURN c.c_custkey AS c, c.c_name AS n", "SELECT DISTINCT c_custkey AS c, c_name AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 350000")
_q("order_multi", "MATCH (p:part) RETURN p.p_brand AS b, p.p_size AS s, p.p_partkey AS k ORDER BY b DESC, s, k", "SELECT p_brand AS b, p_size AS s, p_partkey AS k FROM part ORDER BY 1 DESC, 2, 3")
_q("topk", "MATCH (o:orders) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
_q("order_by_hidden", "MATCH (o:orders) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice * 2, k", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice * 2, 1")
_q("skip_limit", "MATCH (c:customer) RETURN c.c_custkey AS k ORDER BY k SKIP 10 LIMIT 5", "SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 5 OFFSET 10")
_q("with_chain_limit", "MATCH (c:customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20 MATCH (c)-[:placed]->(o:orders) RETURN c.c_custkey AS c, count(*) AS n", "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) GROUP BY 1")
_q("unwind", "UNWIND [1, 2, 3] AS x MATCH (n:nation {n_regionkey: x}) RETURN x, n.n_name AS n", "SELECT n_regionkey AS x, n_name AS n FROM nation WHERE n_regionkey IN (1, 2, 3)")
_q("unwind_collected", "MATCH (n:nation) WITH n.n_regionkey AS r, collect(n.n_name) AS l UNWIND l AS x RETURN r, x", "SELECT n_regionkey AS r, n_name AS x FROM nation")
_q("union_all", "MATCH (c:customer) RETURN c.c_name AS n UNION ALL MATCH (s:supplier) RETURN s.s_name AS n", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier")
_q("union_distinct", "MATCH (c:customer) RETURN c.c_nationkey AS n UNION MATCH (s:supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
_q("call_union", "MATCH (c:customer) CALL (c) { MATCH (c)-[:placed]->(o:orders) RETURN c, count(o) AS n UNION ALL RETURN c, 0 AS n } WITH c, max(n) AS n RETURN c.c_name AS c, n", "SELECT c_name AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_q("id_functions", "MATCH (c:customer)-[k:knows]->(d:customer) RETURN label(c) AS l, label(k) AS t, id(c) = id(d) AS same, count(*) AS n", f"WITH {_KNOWS} SELECT 'customer' AS l, 'knows' AS t, false AS same, count(*) AS n FROM knows")
_q("table_function", "CALL show_loaded_extensions() YIELD `extension name` AS e RETURN e", "SELECT unnest(['csv', 'json', 'parquet']) AS e")


# one for each operator that the others leave out
_q("bits_and_abs", "MATCH (p:part) RETURN p.p_partkey AS k, abs(0 - p.p_size) AS a, p.p_size & 6 AS b, p.p_size | 8 AS c, p.p_size << 2 AS d, p.p_size >> 1 AS e", "SELECT p_partkey AS k, abs(-p_size) AS a, p_size & 6 AS b, p_size | 8 AS c, p_size << 2 AS d, p_size >> 1 AS e FROM part")
_q("date_literal", "MATCH (o:orders) WHERE CAST(o.o_orderdate AS DATE) >= date('1995-06-17') RETURN count(*) AS c", "SELECT count(*) AS c FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-06-17'")
_q("interval_sum", "MATCH (n:nation) WHERE interval('1 day') + interval('2 days') > interval('50 hours') AND interval('3 days') - interval('1 day') = interval('48 hours') RETURN count(*) AS c", "SELECT count(*) AS c FROM nation")
_q("struct_literal", "MATCH (n:nation) WITH {key: n.n_nationkey, name: n.n_name} AS s RETURN struct_extract(s, 'key') AS k, struct_extract(s, 'name') AS n", "SELECT n_nationkey AS k, n_name AS n FROM nation")
_q("random_uuid", "MATCH (n:nation) RETURN n.n_nationkey AS k, size(gen_random_uuid()) AS s", "SELECT n_nationkey AS k, 36 AS s FROM nation")
_q("agg_distinct_sum", "MATCH (p:part) RETURN p.p_brand AS b, sum(DISTINCT p.p_size) AS s, avg(DISTINCT p.p_size) AS a, min(DISTINCT p.p_size) AS m", "SELECT p_brand AS b, sum(DISTINCT p_size) AS s, avg(DISTINCT p_size) AS a, min(p_size) AS m FROM part GROUP BY 1")
_q("null_order", "MATCH (n:customer:nation) WITH n.n_name AS x ORDER BY x LIMIT 30 RETURN x, count(*) AS c", "SELECT n_name AS x, 1 AS c FROM nation UNION ALL SELECT NULL, 5")
_q("empty_result", "MATCH (n:nation)-[:in_region]->(r:region) WHERE n.n_nationkey < 0 AND n.n_nationkey > 0 RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, '' AS r FROM nation WHERE false")
_q("path_kept_fields", "MATCH (a:part)-[p:parent*1..2 (r, n | {}, {n.p_size})]->(b:part) RETURN a.p_partkey AS a, b.p_partkey AS b, properties(nodes(p), 'p_size') AS s",
   "WITH RECURSIVE w AS (SELECT p_partkey AS a, p_partkey AS b, 0 AS n, [p_size] AS s FROM part UNION ALL SELECT a, q.p_partkey, n + 1, list_append(s, q.p_size) FROM w JOIN part q ON q.p_partkey = w.b // 2 WHERE w.b > 0 AND n < 2) SELECT a, b, s FROM w WHERE n >= 1")
_q("weighted_shortest_target", "MATCH (a:customer {c_custkey: 0})-[p:knows*WSHORTEST(w)]->(b:customer {c_custkey: 33}) RETURN b.c_custkey AS b, cost(p) AS c", f"WITH RECURSIVE {_KNOWS}, w AS (SELECT 0::BIGINT AS t, 0::DOUBLE AS c UNION SELECT k.dst, w.c + k.w FROM w JOIN knows k ON k.src = w.t WHERE w.c + k.w <= 60) SELECT t AS b, min(c) AS c FROM w WHERE t = 33 GROUP BY 1")
_q("all_weighted_shortest", "MATCH (a:customer {c_custkey: 0})-[p:knows*ALL WSHORTEST(w)]->(b:customer {c_custkey: 33}) RETURN b.c_custkey AS b, cost(p) AS c, count(*) AS n",
   f"WITH RECURSIVE {_KNOWS}, w AS (SELECT 0::BIGINT AS t, 0::DOUBLE AS c UNION SELECT k.dst, w.c + k.w FROM w JOIN knows k ON k.src = w.t WHERE w.c + k.w <= 60), m AS (SELECT t, min(c) AS c FROM w GROUP BY 1), tight AS (SELECT k.src, k.dst FROM knows k JOIN m a ON a.t = k.src JOIN m b ON b.t = k.dst WHERE a.c + k.w = b.c), p AS (SELECT 0::BIGINT AS t UNION ALL SELECT g.dst FROM p JOIN tight g ON g.src = p.t) SELECT 33 AS b, (SELECT c FROM m WHERE t = 33) AS c, count(*) AS n FROM p WHERE t = 33")
_q("table_info", "CALL table_info('nation') YIELD name AS n, `primary key` AS p RETURN n, p", "SELECT * FROM (VALUES ('n_nationkey', true), ('n_name', false), ('n_regionkey', false)) AS t(n, p)")


def _text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, parameters, _ = TEXTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        given = {k: g.node("nation").df.agg(F.min("n_name")).first()[0] if v == "__first_nation" else v for k, v in parameters.items()}
        return Session(g).execute(text, given)

    return run


def load_parquet_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(Graph(spark)).execute(f"LOAD FROM '{sf_dir}/orders.parquet' WHERE o_totalprice > 300000 RETURN o_orderkey AS k, o_totalprice AS p")


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _roundtrip(end: str) -> Callable[[SparkSession, str], DataFrame]:
    """Writes customers to files of the format, makes nodes of the files, and reads these."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_folder(spark)}.{end}"
        Session(graph(spark, sf_dir)).execute(f"COPY (MATCH (c:customer) RETURN c.c_custkey AS id, c.c_name AS name, c.c_acctbal AS bal, c.c_mktsegment AS seg) TO '{path}' (header = true)")
        s = Session(Graph(spark))
        s.execute("CREATE NODE TABLE client (id INT64, name STRING, bal DOUBLE, seg STRING, PRIMARY KEY (id))")
        s.execute(f"COPY client FROM (LOAD FROM '{path}' (header = true) RETURN id, name, bal, seg)")
        return s.execute("MATCH (c:client) RETURN c.id AS id, c.name AS name, c.bal AS bal, c.seg AS seg")

    return run


def ddl_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made, loaded, changed and emptied in part by statements."""
    g = graph(spark, sf_dir)
    s = Session(Graph(spark))
    for text in (
        "CREATE NODE TABLE land (id INT64, name STRING, region INT32, PRIMARY KEY (id))",
        "CREATE NODE TABLE part_of_world (id INT32, name STRING, PRIMARY KEY (id))",
        "CREATE REL TABLE lies_in (FROM land TO part_of_world, since INT32)",
        f"COPY land FROM (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey, n_name, n_regionkey)",
        f"COPY part_of_world FROM (LOAD FROM '{sf_dir}/region.parquet' RETURN r_regionkey, r_name)",
        f"COPY lies_in FROM (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey, n_regionkey, 1990)",
        "ALTER TABLE land ADD area DOUBLE DEFAULT 1.5",
        "ALTER TABLE land RENAME area TO size",
        "CREATE (a:land {id: 100, name: 'Atlantis', region: 0})",
        "MATCH (a:land {id: 100}), (r:part_of_world {id: 0}) CREATE (a)-[:lies_in {since: 2000}]->(r)",
        "MATCH (a:land) WHERE a.region = 1 SET a.size = a.id * 2.0, a.name = lower(a.name)",
        "MATCH (a:land)-[e:lies_in]->(r) WHERE a.region = 2 SET e.since = 2010",
        "MATCH (a:land)-[e:lies_in]->(r) WHERE a.region = 3 DELETE e",
        "MATCH (a:land) WHERE a.region = 4 DETACH DELETE a",
        "MERGE (a:land {id: 101, name: 'Mu', region: 1}) ON CREATE SET a.size = 9.0",
        "ALTER TABLE land DROP region",
    ):
        s.execute(text)
    del g
    return s.execute("MATCH (a:land) OPTIONAL MATCH (a)-[e:lies_in]->(r:part_of_world) RETURN a.id AS id, a.name AS name, a.size AS size, e.since AS since, r.id AS r")


def load_path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of paths and a pattern, of one format each."""
    g = Graph(spark)
    return Session(g).execute(f"LOAD FROM ['{sf_dir}/nation.parquet', '{sf_dir}/nation.parquet'] RETURN n_name AS n UNION ALL LOAD FROM '{sf_dir}/regi*.parquet' RETURN r_name AS n")


def csv_skip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that begin with lines that are no data."""
    path = f"{_folder(spark)}.csv"
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy((F.col("n_nationkey") % 2).alias("half")).agg(F.concat_ws("\n", F.collect_list(F.concat_ws("|", "n_nationkey", "n_name"))).alias("rows"))
    for half in (0, 1):  # a file each
        lines.where(F.col("half") == half).select(F.concat(F.lit("# made by hand\n# two lines\nk|n\n"), "rows").alias("value")).write.mode("append").text(path)
    return Session(Graph(spark)).execute(f"LOAD FROM '{path}' (header = true, skip_rows = 2) RETURN k, n")


def checkpoint_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is checkpointed, changed and reopened, three times over."""
    path = _folder(spark)
    s = Session.open(spark, path)
    s.execute("CREATE NODE TABLE land (id INT64, name STRING, PRIMARY KEY (id))")
    s.execute(f"COPY land FROM (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey, n_name)")
    for k in range(3):
        s.execute("CHECKPOINT")
        s.execute(f"CREATE (a:land {{id: {100 + k}, name: 'new'}})")
        s.execute("CHECKPOINT")
        s = Session.open(spark, path)
        s.execute(f"MATCH (a:land) WHERE a.id = {k} SET a.name = lower(a.name)")
    s.execute("CHECKPOINT")
    return Session.open(spark, path).execute("MATCH (a:land) RETURN a.id AS id, a.name AS name")


def ddl_drop_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(Graph(spark))
    for text in (
        "CREATE NODE TABLE land (id INT64, name STRING, PRIMARY KEY (id))", "CREATE NODE TABLE gone (id INT64, PRIMARY KEY (id))", "CREATE REL TABLE next_to (FROM land TO land)",
        f"COPY land FROM (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey, n_name)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "DROP TABLE next_to", "ALTER TABLE land RENAME TO country",
    ):
        s.execute(text)
    return s.execute("MATCH (c:country) RETURN c.id AS id, c.name AS name UNION ALL CALL show_tables() YIELD name AS t, type AS y RETURN 0 - 1 AS id, t AS name")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALL of a setting changes what a bare * means: trails for walks."""
    s = Session(graph(spark, sf_dir))
    s.execute("CALL recursive_pattern_semantic = 'trail'")
    return s.execute("MATCH (a:customer)-[p:knows*2..2]-(b:customer) RETURN count(*) AS c")


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph by a schema and a mapping of files."""
    from .sources.bulk import load_graph

    path = _folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.option("sep", "|").option("header", True).csv(f"{path}/land")
    spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS a", "n_nationkey - n_nationkey % 5 AS b").write.option("sep", "|").option("header", True).csv(f"{path}/near")
    prop = lambda name, kind: {"property_name": name, "property_type": kind}
    column = lambda i, name: {"column": {"index": i, "name": name}, "property": name}
    schema = {"schema": {
        "vertex_types": [{"type_name": "land", "properties": [prop("id", {"primitive_type": "DT_SIGNED_INT64"}), prop("name", {"string": {"long_text": None}})], "primary_keys": ["id"]}],
        "edge_types": [{"type_name": "near", "vertex_type_pair_relations": [{"source_vertex": "land", "destination_vertex": "land", "relation": "MANY_TO_MANY"}], "properties": []}],
    }}
    mapping = {
        "loading_config": {"format": {"metadata": {"delimiter": "|"}}},
        "vertex_mappings": [{"type_name": "land", "inputs": ["land"], "column_mappings": [column(0, "id"), column(1, "name")]}],
        "edge_mappings": [{"type_triplet": {"edge": "near", "source_vertex": "land", "destination_vertex": "land"}, "inputs": ["near"], "source_vertex_mappings": [{"column": {"index": 0, "name": "a"}}], "destination_vertex_mappings": [{"column": {"index": 1, "name": "b"}}], "column_mappings": []}],
    }
    return Session(load_graph(spark, schema, mapping, path)).execute("MATCH (a:land)-[:near]->(b:land) RETURN a.id AS id, b.name AS name")


def builtin_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(Graph(spark))
    s.load_builtin_dataset("modern_graph")
    return s.execute("MATCH (a:person)-[c:created]->(b:software) RETURN a.name AS a, b.name AS b, c.weight AS w")


_DDL_SQL = """WITH l AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN n_nationkey * 2.0 ELSE 1.5 END AS size, n_regionkey AS reg FROM nation WHERE n_regionkey <> 4)
SELECT id, name, CAST(size AS DOUBLE) AS size, CASE WHEN reg = 2 THEN 2010 WHEN reg <> 3 THEN 1990 END AS since, CASE WHEN reg <> 3 THEN reg END AS r FROM l
UNION ALL SELECT 100, 'Atlantis', 1.5, 2000, 0 UNION ALL SELECT 101, 'Mu', 9.0, NULL, NULL"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _text_query(n) for n in TEXTS}
QUERIES |= {"load_parquet_pushdown": load_parquet_pushdown, "copy_to_roundtrip": _roundtrip("csv"), "copy_json_roundtrip": _roundtrip("jsonl"), "copy_parquet_roundtrip": _roundtrip("parquet"), "ddl_dml": ddl_dml}
_CLIENTS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer"
ORACLE_SQL: dict[str, str] = {n: sql for n, (_, _, sql) in TEXTS.items()}
ORACLE_SQL |= {"load_parquet_pushdown": "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000", "copy_to_roundtrip": _CLIENTS, "copy_json_roundtrip": _CLIENTS, "copy_parquet_roundtrip": _CLIENTS, "ddl_dml": _DDL_SQL}

_LANDS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"
QUERIES |= {"load_path_list": load_path_list, "csv_skip_rows": csv_skip_rows, "copy_json_array_roundtrip": _roundtrip("json"), "checkpoint_reopen": checkpoint_reopen, "ddl_drop_rename": ddl_drop_rename, "settings": settings, "bulk_load": bulk_load, "builtin_dataset": builtin_dataset}
ORACLE_SQL |= {
    "load_path_list": "SELECT n_name AS n FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region",
    "csv_skip_rows": "SELECT n_nationkey AS k, n_name AS n FROM nation",
    "copy_json_array_roundtrip": _CLIENTS,
    "checkpoint_reopen": f"SELECT id, CASE WHEN id < 3 THEN lower(name) ELSE name END AS name FROM ({_LANDS}) UNION ALL SELECT unnest([100, 101, 102]), 'new'",
    "ddl_drop_rename": f"{_LANDS} UNION ALL SELECT -1, 'country'",
    "settings": f"WITH {_BOTH} SELECT count(*) AS c FROM both_ways x JOIN both_ways y ON x.dst = y.src WHERE x.e <> y.e",
    "bulk_load": "SELECT CAST(a.n_nationkey AS BIGINT) AS id, b.n_name AS name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey - a.n_nationkey % 5",
    "builtin_dataset": "SELECT * FROM (VALUES ('marko', 'lop', 0.4::DOUBLE), ('josh', 'lop', 0.4), ('peter', 'lop', 0.2), ('josh', 'ripple', 1.0)) AS t(a, b, w)",
}
