"""Minimax contiguous partition: whole groups of equal texts are cut into shards whose largest is as small as can be.

Groups stand in the order of their texts' MD5. The smallest feasible capacity is binary-searched; a capacity is
feasible if filling shards greedily from the left needs no more than the wanted number of them. The driver never holds
all groups: it keeps known group boundaries (prefix sums) of bounded number and asks for a finer set only where the
search is still undecided.

Defined cases: a null text has no bytes, its rows make one group of their own; an empty text is another group. Rows with
equal doc_id or wholly repeated rows are placed as rows like any other. An empty table gives an empty result. Other
columns, whatever their names, are not read. A null doc_id is placed as well.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, documents

SHARDS = 24
OVERHEAD = 8
#: Group boundaries that the driver may hold for one round of refinement.
BOUNDARIES = 40_000
#: Rows of the largest cell that numbers its rows in one task.
CELL_ROWS = 50_000


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def _key(text: Column) -> Column:
    """Order of the groups: the digest of the text; null stands before all digests."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _prefixes(groups: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Each group (key, size) with its end, the sum of the sizes up to it; and the sum of all."""
    slot = F.when(F.col("key") == "", 0).otherwise(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    cells = groups.withColumn("cell", F.floor(slot * buckets / 65536).cast("int"))
    totals = {r["cell"]: r["s"] for r in cells.groupBy("cell").agg(F.sum("size").alias("s")).collect()}  # at most `buckets` rows
    begin, starts = 0, []
    for cell in range(buckets):
        starts.append(begin)
        begin += totals.get(cell, 0)
    if not begin:
        return cells.select("key", "size", F.col("size").alias("end")), 0
    offsets = F.array(*[F.lit(x).cast("long") for x in starts]) if buckets <= 64 else None
    spark = groups.sparkSession
    over = Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("run", F.sum("size").over(over))
    if offsets is not None:
        return run.select("key", "size", (F.col("run") + F.element_at(offsets, F.col("cell") + 1)).alias("end")), begin
    table = spark.createDataFrame(list(enumerate(starts)), "cell int, start long")  # one row a cell, 65,536 at most
    return run.join(F.broadcast(table), "cell").select("key", "size", (F.col("run") + F.col("start")).alias("end")), begin


def _smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the ends of the shards but the last."""
    known = [0, total]  # boundaries, ascending
    clear = {total: total}  # a known boundary, and how far from it no unknown one stands

    def last_before(x: int) -> tuple[int, int]:
        """The last boundary up to x: no less than, and no more than."""
        x = min(x, total)
        low = known[bisect_right(known, x) - 1]
        return (low, low) if x <= clear.get(low, low) else (low, x)

    def fits(capacity: int) -> tuple[bool | None, list[tuple[int, int]]]:
        """Whether it is feasible, None if that is not yet known; and the ranges in which the cuts lie."""
        low = high = 0
        open_: list[tuple[int, int]] = []
        for _ in range(shards - 1):
            (a, a_most), (b_least, b) = last_before(low + capacity), last_before(high + capacity)
            if a < a_most or b_least < b:
                open_.append((a, high + capacity))
            low, high = a, b
        if total - low <= capacity:
            return True, open_
        return (False if total - high > capacity else None), open_

    bottom, top = max(largest, -(-total // shards)), total  # the answer is in [bottom, top]
    while True:
        undecided: list[tuple[int, int]] = []
        while bottom < top:
            middle = (bottom + top) // 2
            feasible, open_ = fits(middle)
            if feasible is None:
                undecided = open_
                break
            bottom, top = (bottom, middle) if feasible else (middle + 1, top)
        if not undecided and bottom == top:
            _, undecided = fits(top)
            if not undecided:
                break
        # a finer look at the ranges in which cuts for this capacity lie
        merged: list[list[int]] = []
        for a, b in sorted((max(0, a), min(b, total)) for a, b in undecided):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        parts = max(2, BOUNDARIES // max(1, len(merged)))
        where, slot = F.lit(None).cast("long"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(merged):
            inside = (F.col("end") >= a) & (F.col("end") <= b)
            width = max(1, -(-(b - a + 1) // parts))
            where = F.when(inside, F.floor((F.col("end") - a) / F.lit(width)).cast("long")).otherwise(where)
            slot = F.when(inside, i).otherwise(slot)
        found = (
            ends.select("end", slot.alias("i"), where.alias("part")).where(F.col("i").isNotNull())
            .groupBy("i", "part").agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n")).orderBy("i", "part").collect()
        )  # fmt: skip  at most BOUNDARIES rows and one
        known = sorted({*known, *(x for r in found for x in (r["first"], r["last"]))})
        for i, (a, b) in enumerate(merged):
            begin = a
            for r in (r for r in found if r["i"] == i):
                clear[begin] = max(clear.get(begin, 0), r["first"] - 1)
                if r["n"] == 2:
                    clear[r["first"]] = max(clear.get(r["first"], 0), r["last"] - 1)
                begin = r["last"]
            clear[begin] = max(clear.get(begin, 0), b)
    cuts, at = [], 0
    for _ in range(shards - 1):
        at = last_before(at + top)[0]
        cuts.append(at)
    return top, cuts


def minimax_cuts(df: DataFrame, text: str = "text", shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest capacity, and the key of the last group of each shard but the last ("~" after all keys, "!" before all)."""
    groups = df.select(_key(F.col(f"`{text}`")).alias("key"), _size(F.col(f"`{text}`")).alias("size")).groupBy("key").agg(F.sum("size").alias("size"))
    groups = cut(groups)
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    if not stats["n"]:
        return 0, ["~"] * (shards - 1)
    buckets = min(65536, 1 << max(4, (stats["n"] // CELL_ROWS).bit_length()))
    ends, total = _prefixes(groups, buckets)
    ends = cut(ends)
    capacity, cuts = _smallest_capacity(ends, total, stats["most"], shards)
    keys = {r["end"]: r["key"] for r in ends.where(F.col("end").isin([c for c in set(cuts) if c])).select("end", "key").collect()}
    return capacity, [keys.get(c, "!") for c in cuts]


def assign_shards(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row of df.

    Slots run without gaps from 0 in every shard. They are dealt cell by cell, a cell being the rows of a shard whose
    doc_id has one hash, so that no task numbers a whole shard or a whole group of copies.
    """
    _, keys = minimax_cuts(df, text, shards)
    value = F.col(f"`{text}`")
    shard = sum(((F.col("__key") > F.lit(k)).cast("int") for k in keys), F.lit(0))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), _size(value).alias("size"), F.coalesce(F.crc32(value.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), _key(value).alias("__key"))
    rows = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("__key"))).alias("__hash"))
    rows = cut(rows)
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, -(-most // CELL_ROWS))
    rows = rows.withColumn("__cell", (F.col("__hash") % cells).cast("int"))
    counts = rows.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__cell").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("__at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "__cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__start") + F.col("__at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))
