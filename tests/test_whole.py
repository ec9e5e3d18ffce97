"""Queries read whole tables: no bound on keys and no LIMIT but where it is the feature."""

import re

import pytest

from sparkloom import queries, social

LIMITED = {"topk", "skip_limit", "with_chain_limit", "shortest_filter_limit", "null_order", "optional_start", "empty_result"}


@pytest.mark.parametrize("name", sorted(queries.TEXTS.keys() - LIMITED))
def test_no_bound(name):
    text, _, sql = queries.TEXTS[name]
    assert not re.search(r"(key|event_id) < \d|LIMIT", text) and not re.search(r"(src|key|event_id|\bt) < \d|LIMIT", sql)


def test_every_start(spark, sf_dir):
    """Trails of one edge: each edge from both of its ends, whatever their keys."""
    edges = queries.knows(spark.read.parquet(f"{sf_dir}/customer.parquet")).count()
    assert queries.QUERIES["trail_1_3"](spark, sf_dir).where("n = 1").groupBy().sum("c").first()[0] == 2 * edges


def test_social_graph_has_hubs(spark, sf_dir):
    g = social.graph(spark, sf_dir)
    replies = g.edges["comment", "reply_of", "post"].df
    assert replies.groupBy("d").count().agg({"count": "max"}).first()[0] > 5 * replies.count() / replies.select("d").distinct().count()
