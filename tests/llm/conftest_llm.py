import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a pot of very strong coffee for the visiting judges"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, lang, source) rows, written as a folder of Parquet, beside a benchmark."""

    def made(tmp_path, rows, benchmark=(), extra=None):
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return made


def hostile_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids."""
    long = " ".join(f"w{i}" for i in range(60_000))
    return [
        (1, PROSE, "en", "s0"), (2, PROSE, "en", "s0"), (2, PROSE, "en", "s0"), (3, None, "en", "s1"), (4, "", None, None), (5, " \t\n ", "en", "s1"),
        (None, PROSE + " extra", "en", None), (None, None, None, None), (6, long, "en", "s2"), (7, "a", "de", "s2"), (8, "Größe ñandú 東京 \U0001f600 zß", "de", "s2"), (8, "another text of the same id", "de", "s3"),
        (9, "x\ny\nz\nx\ny\nz", "fr", "s3"), (10, "token = \"04dbebab91ab85687d33eeaaf9ac699e\" mail a.b@mail.example.com", "fr", "s4"), (11, "..!! ?? 123", "es", "s4"),
    ]


CLASHING = ["kept", "n_words", "fp", "component_id", "spans", "shard", "slot", "copy_no", "n_copies", "shuffle_key", "n_entities", "__text", "__row", "__id", "__key", "__doc", "__source", "__u", "__removed", "row", "rate", "node", "lang_pred", "contaminated"]
