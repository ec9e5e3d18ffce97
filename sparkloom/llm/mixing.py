"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Every row is repeated k times, k being the value of a Poisson distribution, whose mean is the repetition rate of the
row's source, at a uniform number hashed from seed, doc_id and text; the copies are then dealt out anew by a hashed key. The rate of a
source is its target weight times the size of the mixture over the size of the source, however high. Beyond a rate of
16, k is the sum of draws of equal means of at most 16, each at a hashed number of its own. OP7_SQL draws alike.

Defined cases: a null source is a source of its own. A null or empty text counts 0 bytes, its row is repeated like the
others of its source; a source of 0 bytes has rate 0. Repeated rows (same doc_id and text) get the same count. An
empty table gives an empty result. Columns whose names clash with those that the operator adds are kept; the operator
then adds under names with a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, like

SEED = "mix-1"
#: Target weight of a source: its size to this power, over the sum of these.
ALPHA = 0.7
#: Size of the mixture over that of the input.
EPOCHS = 1.0
#: Copies that one draw gives at most; its mean is a quarter of this at most, where the tail beyond is below the hash's resolution.
MOST = 64
BITS = 52


def uniform(*parts: Column) -> Column:
    """A hashed number in [0, 1): the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def source_rates(df: DataFrame, source: str = "source", text: str = "text", alpha: float = ALPHA, epochs: float = EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """(source, rate, draws, cdf of one draw): one row a source; weights: optional (source, weight), else size ** alpha."""
    sizes = df.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")), F.lit(0)).alias("__size"))
    if weights is None:
        weighed = sizes.withColumn("__weight", F.when(F.col("__size") > 0, F.pow(F.col("__size").cast("double"), F.lit(alpha))).otherwise(0.0))
    else:
        given = weights.select(F.col("source").alias("__given"), F.col("weight").cast("double").alias("__weight"))
        weighed = sizes.join(given, F.col("__source").eqNullSafe(F.col("__given")), "left").select("__source", "__size", F.coalesce("__weight", F.lit(0.0)).alias("__weight"))
    # sums over the table of sources, not over documents
    sums = weighed.agg(F.sum("__weight").alias("__weights"), F.sum("__size").alias("__sizes"))
    rated = weighed.join(F.broadcast(sums), F.lit(True)).select(
        "__source",
        F.when((F.col("__size") > 0) & (F.col("__weights") > 0), F.lit(epochs) * F.col("__sizes") * F.col("__weight") / F.col("__weights") / F.col("__size")).otherwise(0.0).alias("__rate"),
    ).withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("__rate") / (MOST / 4.0))).cast("int")).withColumn("__mean", F.col("__rate") / F.col("__draws"))
    # P(X <= j) for j = 0 .. MOST, by the recurrence p(j) = p(j - 1) * rate / j
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)),
        F.struct(F.exp(-F.col("__mean")).alias("p"), F.array(F.exp(-F.col("__mean"))).alias("sums")),
        lambda acc, j: F.struct(
            (acc["p"] * F.col("__mean") / j).alias("p"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * F.col("__mean") / j)).alias("sums"),
        ),
        lambda acc: acc["sums"],
    )
    return rated.withColumn("__cdf", cdf).drop("__mean")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, alpha: float = ALPHA, epochs: float = EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """df's columns with copy_no (from 0), n_copies and shuffle_key: the mixture in the order of partitions and keys."""
    copy_no, n_copies, shuffle_key = like("copy_no", df), like("n_copies", df), like("shuffle_key", df)
    u, dg, ident = like("__u", df), like("__digest", df), like("__identity", df)
    rates = source_rates(df, source, text, alpha, epochs, weights)
    of, cdf, draws = like("__source", df), like("__cdf", df), like("__draws", df)
    rates = rates.select(F.col("__source").alias(of), F.col("__cdf").alias(cdf), F.col("__draws").alias(draws))
    digest = F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("null"))
    identity = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))
    drawn = df.withColumns({u: uniform(F.lit(seed), identity, digest), dg: digest, ident: identity})
    # the table of rates has a row a source: Spark broadcasts it below its size limit, else joins by shuffle and splits a hot source
    joined = drawn.join(rates, F.col(f"`{source}`").eqNullSafe(F.col(of)))
    first = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    further = F.transform(F.sequence(F.lit(2), F.col(draws)), lambda k: uniform(F.lit(seed), F.col(ident), F.col(dg), k.cast("string")))
    more = F.aggregate(further, F.lit(0), lambda n, v: n + F.size(F.filter(cdf, lambda c: c <= v)))
    counted = joined.withColumn(n_copies, F.when(F.col(draws) > 1, first + more).otherwise(first))
    copies = counted.where(F.col(n_copies) > 0).withColumn(copy_no, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
    keyed = copies.withColumn(shuffle_key, F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), F.lit("order"), F.col(ident), F.col(dg), F.col(copy_no).cast("string")).cast("binary")), 1, 16))
    dropped = keyed.select(*[F.col(f"`{c}`") for c in df.columns], copy_no, n_copies, shuffle_key)
    return dropped.repartition(shuffle_key).sortWithinPartitions(shuffle_key)


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy in the mixture: doc_id, copy_no, n_copies and its place's key."""
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", F.col("source"), F.col("copy_no").cast("long").alias("copy_no"), F.col("n_copies").cast("long").alias("n_copies"), "shuffle_key")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(md5(text), 'null') AS dg, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident FROM documents),
sizes AS (SELECT source, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS size FROM d GROUP BY source),
weighed AS (SELECT source, size, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), {ALPHA}) ELSE 0 END AS w FROM sizes),
rated AS (SELECT source, CASE WHEN size > 0 THEN {EPOCHS} * (SELECT sum(size) FROM weighed) * w / (SELECT sum(w) FROM weighed) / size ELSE 0 END AS rate FROM weighed),
parts AS (SELECT source, CAST(greatest(1, ceil(rate / {MOST / 4.0})) AS BIGINT) AS draws, rate / greatest(1, ceil(rate / {MOST / 4.0})) AS mean FROM rated),
terms AS (SELECT source, j, CASE WHEN mean > 0 THEN exp(-mean + j * ln(mean) - lgamma(j + 1)) WHEN j = 0 THEN 1 ELSE 0 END AS p FROM parts, range(0, {MOST + 1}) AS r(j)),
cdf AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms),
numbered AS (SELECT *, row_number() OVER () AS rn FROM d),
draws AS (SELECT n.*, unnest(range(1, p.draws + 1)) AS draw FROM numbered n JOIN parts p ON p.source IS NOT DISTINCT FROM n.source),
drawn AS (SELECT *, CAST('0x' || substr(md5(concat_ws(chr(31), '{SEED}', ident, dg, CASE WHEN draw > 1 THEN CAST(draw AS VARCHAR) END)), 1, {BITS // 4}) AS BIGINT) / {float(1 << BITS)} AS u FROM draws),
counted AS (SELECT d.rn, d.doc_id, d.source, d.ident, d.dg, count(c.j) AS n FROM drawn d LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY ALL),
copies AS (SELECT *, unnest(range(0, n)) AS k FROM counted)
SELECT doc_id, source, k AS copy_no, n AS n_copies, substr(md5(concat_ws(chr(31), '{SEED}', 'order', ident, dg, CAST(k AS VARCHAR))), 1, 16) AS shuffle_key FROM copies
"""
