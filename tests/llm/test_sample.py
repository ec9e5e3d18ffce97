"""The labelled sample of languages whose rows are mostly copies."""

from sparkloom.llm import language


def test_copies(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 2 = 0, concat('text ', id % 20), concat('other ', id)) AS text", "if(id % 2 = 0, 'copies', 'various') AS lang")
    found = language.sample(df, "text", "lang", "doc_id", per_lang=20)
    assert sorted(t for t, g in found if g == "copies") == sorted(f"text {k}" for k in range(0, 20, 2))
    usable = df.where("lang = 'various'").where(~language.held_out(df["doc_id"])).selectExpr("text", "xxhash64(text) AS h").orderBy("h").limit(20)
    assert [t for t, g in found if g == "various"] == [r["text"] for r in usable.collect()]
