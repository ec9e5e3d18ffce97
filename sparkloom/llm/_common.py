"""Helpers shared by the text operators."""

from __future__ import annotations

import bisect
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the complement of the word class [^\x20\x09-\x0D].
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of an Arrow batch on its way to a Python worker; a single larger row makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of text that one numpy step works on; a single longer text makes a step of its own.
STEP_BYTES = 3 << 20
#: Parts that the rows of one key are dealt to in a salted join.
SALT = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> None:
    """Takes the cluster's spark.checkpoint.dir; only where none is set (tests) a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder: its lineage ends there and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def salted(df: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """df joined with `small`, where many rows of df may have one key; `by`: a column in which these differ."""
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of data frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """The column as one string array with offsets from 0; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()).fill_null("")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.string())


def raw(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32, count=len(column) + 1).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def steps(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """A string array whose values stand one after another in data."""
    off = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of the texts buf[off[i]:off[i + 1]], each word's text, and the mask of word bytes."""
    inside = ~SPACES[buf]
    n = len(buf)
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    starts = inside.copy()
    starts[1:] &= SPACES[buf[:-1]] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= SPACES[buf[1:]] | first[1:n]
    at, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return at, end, np.searchsorted(off, at, side="right") - 1, inside


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of the marked bytes of each text."""
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def map_texts(df: DataFrame, function: Callable[[pa.StringArray], Iterable[pa.Array]], fields: list[T.StructField], text: str, keep: list[str]) -> DataFrame:
    """df's columns `keep` and what `function` makes of each batch of texts, in one narrow pass."""
    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = list(function(texts(batch.column(len(keep)))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=schema.names)

    # the text stands last under a name of its own, so that it may be one of `keep`
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each span overlaps none of `taken`; both are sorted by start."""
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    # of those that begin before the span's end, the farthest end decides
    return [not (k := bisect.bisect_left(starts, b)) or reach[k - 1] <= a for a, b in spans]


def like(name: str, df: DataFrame) -> str:
    """`name`, or a name made from it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
