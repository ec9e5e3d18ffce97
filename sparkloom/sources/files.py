"""CSV, JSON, JSON-lines and Parquet files as sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import exists
from ..types import spark_type


def format_of(path: str, options: dict[str, Any] | None = None) -> str:
    if options and options.get("format"):
        return str(options["format"]).lower()
    name = path.rsplit("?", 1)[0].lower().rstrip("/*")
    for end, kind in ((".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "json"), (".parquet", "parquet")):
        if name.endswith((end, f"{end}.gz")):
            return kind
    return "csv"


def _yes(value: Any) -> bool:
    return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")


def _is_array(spark: SparkSession, paths: list[str]) -> bool:
    """Whether a JSON file is one array or one object over several lines, and not a document a line."""
    first = spark.read.text(paths).where(F.trim("value") != "").limit(1).collect()
    text = first[0][0].strip() if first else ""
    return text.startswith("[") or not text.endswith("}")


def _without_first(spark: SparkSession, paths: list[str], n: int) -> DataFrame:
    """The lines of the files but the first n of each, as long as these stand in a file's first block."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}  # a block's lines come in order, in one task
        for batch in batches:
            keep = []
            for file, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if start == 0 and seen.get(file, 0) < n:
                    seen[file] = seen.get(file, 0) + 1
                    keep.append(False)
                else:
                    keep.append(True)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["value"])

    return lines.mapInArrow(run, "value string")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, a line each, as one JSON array over several lines."""
    row = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    mark = "["
    for batch in batches:
        lines = []
        for line in batch.column(0).to_pylist():
            lines.append(mark + line)
            mark = ","
        yield row(lines)
    yield row(["[]" if mark == "[" else "]"])


def read(spark: SparkSession, paths: list[str], options: dict[str, Any] | None = None, headers: list[tuple[str, str]] | None = None) -> DataFrame:
    """The rows of files, folders or glob patterns of one format. Options that only steer reading (batch sizes, threads) don't matter here."""
    options = {k.lower(): v for k, v in (options or {}).items()}
    kind = format_of(paths[0], options)
    if kind == "parquet":
        return spark.read.parquet(*paths)
    if kind in ("json", "jsonl"):
        return spark.read.option("multiLine", kind == "json" and _is_array(spark, paths)).json(paths)
    if _yes(options.get("autogenerate_column_names", False)):
        options["header"] = False
    reader = spark.read.option("sep", options.get("delim", options.get("delimiter", "|"))).option("header", _yes(options.get("header", True)))
    reader = reader.option("quote", options.get("quote", '"') if _yes(options.get("quoting", True)) else "").option("escape", options.get("escape", "\\") if _yes(options.get("escaping", True)) else "\x00")
    reader = reader.option("nullValue", options.get("null", "")).option("timestampFormat", "yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS][.SSS]").option("enforceSchema", True)
    paths: Any = list(paths)
    names = None
    if skipped := int(options.get("skip_rows", 0)):
        if _yes(options.get("header", True)):  # each file has a header line below
            first = _without_first(spark, paths, skipped).first()
            names = next(csv.reader([first[0]], delimiter=options.get("delim", options.get("delimiter", "|")), quotechar=options.get("quote", '"'))) if first else None
            skipped, reader = skipped + 1, reader.option("header", False)
        lines = getattr(_without_first(spark, paths, skipped)._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
        read_csv = lambda r: DataFrame(r._jreader.csv(lines), spark)
    else:
        read_csv = lambda r: r.csv(paths)
    if headers:
        return read_csv(reader.schema(T.StructType([T.StructField(n, T.StringType() if not isinstance(spark_type(k), T.AtomicType) else spark_type(k)) for n, k in headers])))
    df = read_csv(reader.option("inferSchema", True).option("preferDate", True))
    if names:
        df = df.toDF(*names)
    elif not _yes(options.get("header", True)):
        df = df.toDF(*[f"f{i}" for i in range(len(df.columns))])
    # the language's timestamps have no time zone
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema])


def write(df: DataFrame, path: str, options: dict[str, Any] | None = None) -> None:
    """Writes df in the format that the path ends with; a CSV column of nodes, lists or structs holds JSON text.

    The path becomes a folder; each of its `.json` files is one array, each `.jsonl` file a document a line. A folder of the
    same path is replaced, unless `overwrite = false` says that it has to be an error.
    """
    options = {k.lower(): v for k, v in (options or {}).items()}
    kind = format_of(path, options)
    if exists(df.sparkSession, path) and not _yes(options.get("overwrite", True)):
        raise FileExistsError(path)
    out = df.write.mode("overwrite")
    if kind == "parquet":
        out.parquet(path)
    elif kind == "jsonl":
        out.json(path)
    elif kind == "json":
        documents = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
        documents.mapInArrow(_arrays, "value string").write.mode("overwrite").text(path)
    else:
        flat = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema])
        flat.write.mode("overwrite").option("sep", options.get("delim", options.get("delimiter", "|"))).option("header", _yes(options.get("header", True))).option("quote", options.get("quote", '"')).option("escape", options.get("escape", "\\")).csv(path)
