"""Rates beyond what one draw gives."""

import numpy as np
from oracle import same

from sparkloom.llm import mixing


def test_high_rates(spark):
    """A source of 1 % of the text that is to be half of the mixture; and one row that is to be all of it."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', lpad(id, 6, '0')) AS text", "if(id % 100 = 0, 'rare', 'common') AS source")
    weights = spark.createDataFrame([("rare", 1.0), ("common", 1.0)], "source string, weight double")
    assert {r["__source"]: round(r["__rate"], 6) for r in mixing.source_rates(df, weights=weights).collect()} == {"rare": 50.0, "common": round(0.5 / 0.99, 6)}
    counts = [r["n"] for r in mixing.mix(df, weights=weights).where("source = 'rare'").groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()]
    assert len(counts) == 400 and abs(np.mean(counts) - 50) < 1.5 and 38 < np.var(counts) < 62
    alone = df.selectExpr("doc_id", "text", "if(doc_id = 0, 'one', 'common') AS source")
    assert abs(mixing.mix(alone, weights=spark.createDataFrame([("one", 1.0)], "source string, weight double")).count() - 40_000) < 1200


def test_high_rates_by_sql(spark, make, tmp_path):
    """Sources whose rates need several draws, against the SQL."""
    rows = [(i, "text " * 4000, "en", "large") for i in range(40)] + [(100 + i, f"t{i}", "en", f"small{i % 3}") for i in range(30)]
    path = make(tmp_path, rows)
    rates = [r["__rate"] for r in mixing.source_rates(spark.read.parquet(f"{path}/documents.parquet")).collect()]
    assert max(rates) > 16
    same(mixing.op7_poisson_mix(spark, path), mixing.OP7_SQL, path)
