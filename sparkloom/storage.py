"""Where loops cut their lineage (the shared folder that the cluster names in spark.checkpoint.dir), and files of any file system that Spark reads."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; only where none is set (tests) one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: later plans begin there, and lost executors cost nothing.

    Its statistics are of the rows that were written. checkpoint() keeps what Spark guessed before: of exploded or compressed
    input too little, so that millions of edges went through the driver as broadcasts; of joins far too much.
    """
    shared_folder(df.sparkSession)
    seen = Observation()
    return _sized(df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True), seen.get["n"])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A checkpointed frame of so many rows, with statistics that say so."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    plan = df._jdf.queryExecution().analyzed()
    size = rows * (8 + df._jdf.schema().defaultSize())
    stats = spark.range(size // 8 + 1)._jdf.queryExecution().optimizedPlan().stats()  # of as many bytes: Python can't hold a Scala BigInt
    sized = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, jvm.scala.Option.apply(stats), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def unpacked(df: DataFrame, seen: set[str]) -> None:
    """Lets Spark plan by what the Parquet files below df hold rather than by their size, which is a tenth and less of that where columns repeat.

    The session's factor from file to table becomes the largest of these (files state their rows); so no table counts as
    smaller than it is, and what is large goes through no driver as a broadcast. seen: the files that were looked at.
    """
    spark, jvm, factor = df.sparkSession, df.sparkSession.sparkContext._jvm, "spark.sql.sources.fileCompressionFactor"
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation" or "Parquet" not in leaf.relation().fileFormat().getClass().getName():
            continue
        files = leaf.relation().location()
        if (name := files.rootPaths().mkString(",")) in seen:
            continue
        seen.add(name)
        if written := files.sizeInBytes():
            rows = DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, leaf), spark).count()
            held = rows * (8 + leaf.schema().defaultSize()) / written
            if held > float(spark.conf.get(factor)):
                spark.conf.set(factor, str(held))


def _at(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands in the folder; nothing if there is none."""
    fs, at = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
