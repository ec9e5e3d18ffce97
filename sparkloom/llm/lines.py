"""Line dedup over windows of three consecutive lines that overlap.

Every window is hashed, repeated windows are found over all documents, and each occurrence but the first (by doc_id,
then by line) marks its three lines; marked positions are merged and their lines removed.

Defined cases: a null text stays null and has no line; an empty text has one empty line. A text of one or two lines has
no window and stays as it is. Windows without any word (only blank lines) don't count. Rows with the same doc_id are
told apart by their text; wholly repeated rows are alike, so all of them are treated as the first one is: they keep
what it keeps. A null doc_id stands before all others. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, documents, like

LINES = 3


def line_windows(df: DataFrame, text: str, doc_id: str, size: int = LINES) -> DataFrame:
    """(doc, at, high, low) of each window that has a word: its row's id and text hash, its first line from 0, and two hashes.

    Lines are hashed once each; a window's hashes are those of its lines' hashes.
    """
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("low"), x).alias("l"), x.rlike(r"[^\x20\x09-\x0D]").alias("w"))
    value = F.col(f"`{text}`")
    rows = df.select(F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(value).alias("t")).alias("doc"), F.transform(F.split(value, "\n", -1), line).alias("lines"))
    rows = rows.where(F.size("lines") >= size)
    # the lines beside each other: no look-up by place, so that the work follows the number of lines
    beside = F.arrays_zip(*[F.slice("lines", k + 1, F.size("lines") - (size - 1)).alias(f"x{k}") for k in range(size)])
    windows = F.transform(
        beside,
        lambda z, i: F.struct(
            i.cast("int").alias("at"), F.xxhash64(*[z[f"x{k}"]["h"] for k in range(size)]).alias("high"), F.xxhash64(*[z[f"x{k}"]["l"] for k in range(size)]).alias("low"),
            F.greatest(*[z[f"x{k}"]["w"] for k in range(size)]).alias("word"),
        ),
    )
    return rows.select("doc", F.explode(windows).alias("w")).where("w.word").select("doc", "w.at", "w.high", "w.low")


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = LINES) -> DataFrame:
    """df with its text column without the lines of later occurrences, and n_removed, the number of these."""
    # read twice below: for the first places, and for the later ones
    windows = cut(line_windows(df, text, doc_id, size))
    # the first place of a hash is summed before the shuffle to a row a hash and task, however many rows hold it
    firsts = windows.groupBy("high", "low").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # a hash that many rows hold stands in one row of firsts: Spark splits the hot side
    again = windows.join(firsts.select("high", "low", "first"), ["high", "low"]).where(F.struct("doc", "at") > F.col("first"))
    marks = again.groupBy("doc").agg(F.collect_set("at").alias("at"))
    gone, doc, key, lines, kept, count = (like(c, df) for c in ("__gone", "__doc", "__key", "__lines", "__kept", "n_removed"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + (size - 1)))))
    marks = cut(marks.select(F.col("doc").alias(doc), covered.alias(gone)))
    value = F.col(f"`{text}`")
    joined = df.withColumn(key, F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(value).alias("t"))).join(marks, F.col(key).eqNullSafe(F.col(doc)), "left")
    split = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(value, "\n", -1)))
    left = split.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return left.select(*[F.when(F.col(gone).isNull(), value).otherwise(rest).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns], F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(count))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), "n_removed", F.col("text").alias("text"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, text, i - 1 AS pos, array_to_string(list_slice(ls, i, i + 2), chr(10)) AS w
      FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3)),
v AS (SELECT * FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM v),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, range(0, 3) AS r(k) WHERE n > 1),
ls AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
kept AS (SELECT ls.doc_id, string_agg(line, chr(10) ORDER BY ls.pos) FILTER (gone.pos IS NULL) AS text, count(gone.pos) AS n_removed
         FROM ls LEFT JOIN gone ON gone.doc_id = ls.doc_id AND gone.pos = ls.pos GROUP BY ls.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE greatest(1, len(d.ls) - coalesce(n_removed, 0)) END AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
