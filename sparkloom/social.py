"""The nine subgraph queries of the public LSQB benchmark, on a social network with hubs that is derived from the driver's tables.

A tenth of the comments answers one of seven posts, three forums have a third of all persons each, ten tags and ten persons
are known to everything else; so joins meet hot keys, and cycles close on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import Graph
from .session import Session
from .storage import cut, shared_folder

#: Keys of the nodes of each label. {table} is a table, <table> its number of rows.
_NODES = {
    "person": "SELECT c_custkey AS id FROM {customer}",
    "city": "SELECT DISTINCT (c_custkey - c_custkey % 8) % 100 AS id FROM {customer}",
    "country": "SELECT CAST(n_nationkey AS BIGINT) AS id FROM {nation}",
    "forum": "SELECT s_suppkey AS id FROM {supplier}",
    "post": "SELECT o_orderkey AS id FROM {orders}",
    "comment": "SELECT event_id AS id FROM {events}",
    "tag": "SELECT p_partkey AS id FROM {part}",
    "tagclass": "SELECT DISTINCT p_partkey % 50 AS id FROM {part}",
}
#: (type, source, target) -> its edges' ends.
_EDGES = {
    ("in_country", "city", "country"): "SELECT DISTINCT (c_custkey - c_custkey % 8) % 100 AS s, (c_custkey - c_custkey % 8) % 100 % 25 AS d FROM {customer}",
    ("in_city", "person", "city"): "SELECT c_custkey AS s, (c_custkey - c_custkey % 8) % 100 AS d FROM {customer}",
    ("member", "forum", "person"): "SELECT DISTINCT s, d FROM (SELECT c_custkey % <supplier> AS s, c_custkey AS d FROM {customer} UNION ALL SELECT c_custkey * 3 % <supplier>, c_custkey FROM {customer} UNION ALL SELECT c_custkey % 3, c_custkey FROM {customer}) AS x",
    ("holds", "forum", "post"): "SELECT o_orderkey % <supplier> AS s, o_orderkey AS d FROM {orders}",
    ("made_by", "post", "person"): "SELECT o_orderkey AS s, o_custkey AS d FROM {orders}",
    ("made_by", "comment", "person"): "SELECT event_id AS s, (user_id * 13 + event_id) % <customer> AS d FROM {events}",
    ("reply_of", "comment", "post"): "SELECT event_id AS s, CASE WHEN event_id % 10 = 0 THEN event_id % 7 ELSE event_id * 31 % <orders> END AS d FROM {events} WHERE event_id % 2 = 0",
    ("reply_of", "comment", "comment"): "SELECT event_id AS s, event_id - 1 AS d FROM {events} WHERE event_id % 2 = 1",
    ("has_tag", "post", "tag"): "SELECT DISTINCT s, d FROM (SELECT o_orderkey AS s, o_orderkey * 3 % <part> AS d FROM {orders} UNION ALL SELECT o_orderkey, o_orderkey * 5 % 10 FROM {orders}) AS x",
    ("has_tag", "comment", "tag"): "SELECT DISTINCT s, d FROM (SELECT event_id AS s, event_id * 11 % <part> AS d FROM {events} UNION ALL SELECT event_id, event_id % 10 FROM {events}) AS x",
    ("of_class", "tag", "tagclass"): "SELECT p_partkey AS s, p_partkey % 50 AS d FROM {part}",
    ("likes", "person", "post"): "SELECT event_id * 7 % <customer> AS s, event_id * 13 % <orders> AS d FROM {events}",
    ("likes", "person", "comment"): "SELECT event_id * 5 % <customer> AS s, event_id * 19 % <events> AS d FROM {events} WHERE event_id % 3 = 0",
    ("knows", "person", "person"): "SELECT DISTINCT s, d FROM (SELECT c_custkey AS s, (c_custkey + 1) % <customer> AS d FROM {customer} UNION ALL SELECT c_custkey, (c_custkey + 2) % <customer> FROM {customer} UNION ALL SELECT c_custkey, (7 * c_custkey + 3) % <customer> FROM {customer} UNION ALL SELECT c_custkey, c_custkey % 10 FROM {customer} WHERE c_custkey % 3 = 0) AS x WHERE s <> d",
    ("interest", "person", "tag"): "SELECT DISTINCT s, d FROM (SELECT c_custkey AS s, c_custkey * 11 % <part> AS d FROM {customer} UNION ALL SELECT c_custkey, c_custkey % 5 FROM {customer}) AS x",
}
_TABLES = "customer nation supplier orders events part".split()

_graphs: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The network of the tables in sf_dir; its edges are made once and kept in the shared folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at in _graphs:
        return _graphs[at]
    shared_folder(spark)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    counts = {t: df.count() for t, df in tables.items()}

    def made(text: str) -> DataFrame:
        for t, n in counts.items():
            text = text.replace(f"<{t}>", str(n))
        return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})

    g = Graph(spark)
    for label, text in _NODES.items():
        g.add_nodes(label, made(text), "id")
    for (kind, a, b), text in _EDGES.items():
        g.add_edges(kind, a, b, cut(made(text)), "s", "d")
    _graphs[at] = g
    return g


_MESSAGE = "(:tag)<-[:has_tag]-(message:post:comment)-[:made_by]->(creator:person)"
_TAGS = "(tag1:tag)<-[:has_tag]-(message:post:comment)<-[:reply_of]-(comment:comment)-[:has_tag]->(tag2:tag)"
_FRIENDS = "(person1:person)-[:knows]-(person2:person)-[:knows]-(person3:person)-[:interest]->(tag:tag)"
TEXTS = {
    "social_q1": "MATCH (:country)<-[:in_country]-(:city)<-[:in_city]-(:person)<-[:member]-(:forum)-[:holds]->(:post)<-[:reply_of]-(:comment)-[:has_tag]->(:tag)-[:of_class]->(:tagclass) RETURN count(*) AS c",
    "social_q2": "MATCH (person1:person)-[:knows]-(person2:person), (person1)<-[:made_by]-(comment:comment)-[:reply_of]->(post:post)-[:made_by]->(person2) RETURN count(*) AS c",
    "social_q3": "MATCH (person1:person)-[:in_city]->(city1:city)-[:in_country]->(country:country), (person2:person)-[:in_city]->(city2:city)-[:in_country]->(country), (person3:person)-[:in_city]->(city3:city)-[:in_country]->(country), (person1)-[:knows]-(person2)-[:knows]-(person3), (person3)-[:knows]-(person1) RETURN count(*) AS c",
    "social_q4": f"MATCH {_MESSAGE}, (message)<-[:likes]-(liker:person), (message)<-[:reply_of]-(comment:comment) RETURN count(*) AS c",
    "social_q5": f"MATCH {_TAGS} WHERE id(tag1) <> id(tag2) RETURN count(*) AS c",
    "social_q6": f"MATCH {_FRIENDS} WHERE id(person1) <> id(person3) RETURN count(*) AS c",
    "social_q7": f"MATCH {_MESSAGE} OPTIONAL MATCH (message)<-[:likes]-(liker:person) OPTIONAL MATCH (message)<-[:reply_of]-(comment:comment) RETURN count(*) AS c",
    "social_q8": f"MATCH {_TAGS} WHERE NOT EXISTS {{ MATCH (comment)-[:has_tag]->(tag1) }} AND id(tag1) <> id(tag2) RETURN count(*) AS c",
    "social_q9": f"MATCH {_FRIENDS} WHERE NOT EXISTS {{ MATCH (person1)-[:knows]-(person3) }} AND id(person1) <> id(person3) RETURN count(*) AS c",
}


def _tables_sql() -> str:
    """The edges as SQL tables; those of messages hold the message's label."""
    parts = []
    for (kind, a, b), text in _EDGES.items():
        for t in _TABLES:
            text = text.replace(f"<{t}>", f"(SELECT count(*) FROM {t})").replace(f"{{{t}}}", t)
        parts.append(f"{kind}_{a}_{b} AS MATERIALIZED ({text})")
    parts += [
        "knows AS MATERIALIZED (SELECT s, d FROM knows_person_person UNION ALL SELECT d, s FROM knows_person_person)",
        "has_tag AS MATERIALIZED (SELECT 'post' AS l, s, d FROM has_tag_post_tag UNION ALL SELECT 'comment', s, d FROM has_tag_comment_tag)",
        "made_by AS MATERIALIZED (SELECT 'post' AS l, s, d FROM made_by_post_person UNION ALL SELECT 'comment', s, d FROM made_by_comment_person)",
        "reply_of AS MATERIALIZED (SELECT 'post' AS l, s, d FROM reply_of_comment_post UNION ALL SELECT 'comment', s, d FROM reply_of_comment_comment)",
        "likes AS MATERIALIZED (SELECT 'post' AS l, s, d FROM likes_person_post UNION ALL SELECT 'comment', s, d FROM likes_person_comment)",
        "lives AS MATERIALIZED (SELECT p.s, c.d FROM in_city_person_city p JOIN in_country_city_country c ON p.d = c.s)",
    ]
    return "WITH " + ",\n".join(parts) + "\n"


_MESSAGE_SQL = "has_tag t JOIN made_by m ON m.l = t.l AND m.s = t.s"
_TAGS_SQL = "has_tag t JOIN reply_of r ON r.l = t.l AND r.d = t.s JOIN has_tag_comment_tag u ON u.s = r.s WHERE t.d <> u.d"
_FRIENDS_SQL = "knows a JOIN knows b ON a.d = b.s JOIN interest_person_tag i ON i.s = b.d WHERE a.s <> b.d"
_SQL = {
    "social_q1": "member_forum_person m JOIN lives l ON l.s = m.d JOIN holds_forum_post h ON h.s = m.s JOIN reply_of_comment_post r ON r.d = h.d JOIN has_tag_comment_tag t ON t.s = r.s JOIN of_class_tag_tagclass c ON c.s = t.d",
    "social_q2": "knows k JOIN made_by_comment_person m ON m.d = k.s JOIN reply_of_comment_post r ON r.s = m.s JOIN made_by_post_person p ON p.s = r.d AND p.d = k.d",
    "social_q3": "knows a JOIN knows b ON a.d = b.s JOIN knows c ON c.s = b.d AND c.d = a.s JOIN lives x ON x.s = a.s JOIN lives y ON y.s = b.s AND y.d = x.d JOIN lives z ON z.s = c.s AND z.d = x.d",
    "social_q4": f"{_MESSAGE_SQL} JOIN likes k ON k.l = t.l AND k.d = t.s JOIN reply_of r ON r.l = t.l AND r.d = t.s",
    "social_q5": _TAGS_SQL,
    "social_q6": _FRIENDS_SQL,
    "social_q7": f"{_MESSAGE_SQL} LEFT JOIN likes k ON k.l = t.l AND k.d = t.s LEFT JOIN reply_of r ON r.l = t.l AND r.d = t.s",
    "social_q8": f"{_TAGS_SQL} AND NOT EXISTS (SELECT 1 FROM has_tag_comment_tag v WHERE v.s = r.s AND v.d = t.d)",
    "social_q9": f"{_FRIENDS_SQL} AND NOT EXISTS (SELECT 1 FROM knows z WHERE z.s = a.s AND z.d = b.d)",
}
ORACLE_SQL = {name: f"{_tables_sql()}SELECT count(*) AS c FROM {text}" for name, text in _SQL.items()}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(graph(spark, sf_dir)).execute(TEXTS[name])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in TEXTS}
