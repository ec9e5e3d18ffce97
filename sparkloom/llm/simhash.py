"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 of 64 bits have a value in common that differs from each in at most 2. So
every distinct fingerprint emits all 1 + 64 + 2016 values within 2 bits, these are shuffled by value, and fingerprints
that meet at a value are linked after their distance is verified. All fingerprints that meet at one value are within 4
bits of each other, so linking each to the smallest of them gives the same components without all pairs; what a task
finds is reduced to a spanning forest before it goes out.

The values are dealt by a hash that is linear over XOR: hash(x ^ flips) = hash(x) ^ hash(flips). A slice or bucket of
the values can so be made without making the others, and the values of a dense ball of fingerprints spread evenly. The
slices are shuffled one after another, so that only one slice of the values is on disk at a time. A record is the value
and the number of its flips (10 bytes), packed by bucket.

Two kinds of fingerprints are built. `shingles` weighs every 4-word shingle alike; texts that share four fifths of their
5-word shingles mostly differ in more than 4 of its bits (5 to 9 in the test tables), so that it finds little beyond
equal texts. `words` weighs every distinct word by 1 + ln(its count), in which such texts differ in some 3 bits; keep_one() takes it.

Joins on a component's root, which a third of all rows may share, are salted: the side with one row a root is
repeated a few times, the other dealt by root and node.

Defined cases: a null, empty or blank text has fingerprint 0, linked like any other; a text of fewer words than a
shingle has the hash of its whole word sequence as its only one. Repeated rows and equal ids share a component like any equal texts. A row with null doc_id
belongs to the component of its text; component_id is the smallest non-null id, null if there is none. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, documents, like, map_texts, raw, release, salted

WORDS = 4
SEED = 42
RADIUS = 4
#: Shingles of a long text that are hashed at a time.
BLOCK = 1 << 16
#: The values are dealt to at least 2 ** LEAST_SLICE_BITS slices, and to more from SLICE_RECORDS records a slice on.
LEAST_SLICE_BITS = 3
SLICE_RECORDS = 1 << 36
#: Records of a bucket and of a partition, on average; and records that a task makes at a time.
BUCKET_RECORDS = 1 << 19
PARTITION_RECORDS = 1 << 23
STEP_RECORDS = 1 << 19
#: Distinct fingerprints of a task, on average, and tasks from which on they have more.
TASK_FINGERPRINTS = 16_384
TASKS = 100_000
#: Unit of the whole-number weights of words.
UNIT = 1024


def fingerprint(text: bytes, words: int = WORDS) -> int:
    tokens = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    first = min(words, len(tokens)) - 1
    starts = np.concatenate(([0], ends[: len(tokens) - first - 1] + 1))
    last, digest = ends[first:], xxhash.xxh64_intdigest
    bits, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), last[k : k + BLOCK].tolist(), strict=True)], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def word_fingerprint(text: bytes) -> int:
    """A bit is 1 if the weights of the distinct words that have it in their hash are over half of all weights."""
    counts = Counter(text.lower().split())
    if not counts:
        return 0
    words, n = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
    weights = np.rint(UNIT * (1 + np.log(n))).astype(np.int64)
    sums, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(words), BLOCK):
        hashes = np.array([digest(w, SEED) for w in words[k : k + BLOCK]], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += weights[k : k + BLOCK] @ bits
    return int(np.packbits(2 * sums > weights.sum(), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS, kind: str = "shingles") -> DataFrame:
    """df's columns `keep` and fp (a signed long) of every row."""
    of = {"shingles": lambda data: fingerprint(data, words), "words": word_fingerprint}[kind]

    def run(column: pa.StringArray) -> Iterator[pa.Array]:
        buf, off = raw(column)
        data = buf.tobytes()
        yield pa.array(np.array([of(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64).view(np.int64))

    return map_texts(df, run, [T.StructField("fp", T.LongType())], text, ["doc_id"] if keep is None else keep)


class Ball:
    """The values within half the radius (rounded up) of a fingerprint, and the linear hash that deals them."""

    def __init__(self, radius: int) -> None:
        if not 0 <= radius <= 6:
            raise ValueError(f"radius {radius}: balls are built for radii of 0 to 6")
        half = (radius + 1) // 2
        flips = [0, *(1 << i for i in range(64))]
        if half >= 2:
            flips += [1 << i | 1 << j for i in range(64) for j in range(i)]
        if half >= 3:
            flips += [1 << i | 1 << j | 1 << k for i in range(64) for j in range(i) for k in range(j)]
        self.flips = np.array(flips[: None if half else 1], np.uint64)
        column = np.random.default_rng(20).integers(0, 1 << 32, 64, np.uint64)
        self.tables = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for value in range(256):
                self.tables[byte, value] = np.bitwise_xor.reduce(column[[8 * byte + k for k in range(8) if value >> k & 1]]) if value else 0

    def hashed(self, values: np.ndarray) -> np.ndarray:
        octets = values.view(np.uint8).reshape(-1, 8)
        out = self.tables[0][octets[:, 0]]
        for byte in range(1, 8):
            out ^= self.tables[byte][octets[:, byte]]
        return out


def _emit(ball: Ball, at: int, slice_bits: int, bucket_bits: int):
    """Of the fingerprints, the values in slice `at`, packed by bucket."""
    low, mask = np.uint64(slice_bits), np.uint64((1 << slice_bits) - 1)
    of_flips = ball.hashed(ball.flips)
    by_slice = [np.flatnonzero((of_flips & mask) == k) for k in range(1 << slice_bits)]
    step = max(1, (STEP_RECORDS << slice_bits) // len(ball.flips))
    keep = np.uint64((1 << bucket_bits) - 1)

    def pack(x: np.ndarray) -> pa.RecordBatch:
        h = ball.hashed(x)
        values, codes, buckets = [], [], []
        for k in range(1 << slice_bits):
            own, flips = np.flatnonzero((h & mask) == np.uint64(k)), by_slice[k ^ at]
            values.append((x[own, None] ^ ball.flips[flips]).ravel())
            codes.append(np.broadcast_to(flips.astype(np.uint16), (len(own), len(flips))).ravel())
            buckets.append(((h[own, None] ^ of_flips[flips]) >> low & keep).astype(np.uint16 if bucket_bits <= 16 else np.uint32).ravel())
        value, code, bucket = map(np.concatenate, (values, codes, buckets))
        order = np.argsort(bucket, kind="stable")
        value, code, bucket = value[order], code[order], bucket[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
        ends = [*head[1:].tolist(), len(bucket)][: len(head)]
        blobs = [(value[a:b].tobytes(), code[a:b].tobytes()) for a, b in zip(head.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), pa.array([v for v, _ in blobs], pa.binary()), pa.array([c for _, c in blobs], pa.binary())], names=["bucket", "v", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
            if sum(map(len, held)) >= step:
                yield pack(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield pack(np.concatenate(held))

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _meet(ball: Ball, radius: int):
    """Links between fingerprints that meet at a value; the rows come sorted by bucket."""

    def links(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        ordered = np.sort(v)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return None
        marks = np.zeros(1 << 20, dtype=bool)
        low = np.uint64((1 << 20) - 1)
        marks[twice & low] = True
        some = np.flatnonzero(marks[v & low])
        some = some[np.argsort(v[some], kind="stable")]
        v, x = v[some], v[some] ^ ball.flips[c[some]]
        head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        runs = np.diff(np.concatenate((head, [len(v)])))
        # of an odd radius: two that both made all flips may be too far apart, but each pair also meets where one made fewer
        near = np.bitwise_count(ball.flips[c[some]]) <= radius // 2
        least = np.repeat(np.minimum.reduceat(np.where(near, x, ~np.uint64(0)), head), runs)
        apart = np.bitwise_count(x ^ least)
        real = (apart > 0) & (apart <= radius) & np.repeat(np.logical_or.reduceat(near, head), runs)
        return (x[real], least[real]) if real.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vs, cs, found, size = None, [], [], [], 0

        def close() -> None:
            nonlocal found, size
            if vs and (pair := links(np.concatenate(vs), np.concatenate(cs))):
                found.append(pair)
                size += len(pair[0])
                if size > 1 << 20:
                    found = [_forest(np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found]))]
                    size = len(found[0][0])

        for batch in batches:
            for bucket, v, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket != now:
                    close()
                    now, vs, cs = bucket, [], []
                vs.append(np.frombuffer(v.as_buffer(), np.uint64))
                cs.append(np.frombuffer(c.as_buffer(), np.uint16))
        close()
        if found:
            a, b = _forest(np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) but the roots: large-star and small-star rounds until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = salted(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, least, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = cut(small)
        # both are sets of edges of the same components: they are equal if nothing of one is missing in the other
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that give the components of the distinct fingerprints fps (fp), which differ in at most `radius` bits."""
    spark = fps.sparkSession
    ball = Ball(radius)
    n = fps.count()
    slice_bits = max(LEAST_SLICE_BITS, (n * len(ball.flips) // SLICE_RECORDS).bit_length())
    records = n * len(ball.flips) >> slice_bits  # of a slice
    bits = (records // BUCKET_RECORDS).bit_length()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // PARTITION_RECORDS))
    fps = cut(fps.select("fp").repartition(max(spark.sparkContext.defaultParallelism, min(TASKS, -(-n // TASK_FINGERPRINTS))), "fp"))
    out = None
    for at in range(1 << slice_bits):
        values = fps.mapInArrow(_emit(ball, at, slice_bits, bits), "bucket int, v binary, c binary")
        found = cut(values.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(ball, radius), "a long, b long"))
        out = found if out is None else out.union(found)
        del values, found
        release(spark)  # this slice's shuffle files
    return out


def grouped(firsts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, least): of each distinct fingerprint of firsts (fp, first), the least `first` of its component."""
    roots = components(links(firsts, radius))  # none of single ones
    members = cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(firsts, F.col("node") == F.col("fp")).select("fp", "root", "first"))
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    several = salted(members, least, "root", "fp").select("fp", "least")
    return firsts.join(members.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("least")).union(several)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS, kind: str = "shingles") -> DataFrame:
    """doc_id, fp (signed) and component_id of every row."""
    rows = cut(fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"], words, kind))
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return rows.join(grouped(firsts, radius), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def op10_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, kind: str = "words") -> DataFrame:
    """df with exactly one row of each component: that of its smallest id (null last), of equal ids that of the smallest MD5 of its text."""
    own, digest, n = like("__id", df), like("__digest", df), like("__n", df)
    of_text = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))  # null counts as empty
    keyed = df.select(F.col(f"`{doc_id}`").alias("id"), of_text.alias("digest"), F.col(f"`{text}`").alias("text"))
    rows = cut(fingerprints(keyed, "text", ["id", "digest"], kind=kind).groupBy("fp", "id", "digest").agg(F.count(F.lit(1)).alias("n")))
    firsts = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n")).alias("first")))
    chosen = cut(grouped(firsts, radius).select("least.id", "least.digest", "least.n").distinct())
    names = chosen.select(F.col("id").alias(own), F.col("digest").alias(digest), F.col("n").alias(n))
    out = df.join(names.select(own, digest), F.col(f"`{doc_id}`").eqNullSafe(F.col(own)) & (of_text == F.col(digest)), "left_semi")
    if names.where(F.col(n) > 1).isEmpty():
        return out
    # repeated rows: one of each id and text; the others don't share a key with them
    return out.withColumn(digest, of_text).dropDuplicates([doc_id, digest]).drop(digest)
