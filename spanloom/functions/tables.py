"""Durable intermediate tables and running sums that no single task has to make."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


#: Rows of repeated values take this many times the bytes of their Parquet files in memory, or more.
FILE_FACTOR = 64


def sized_by_rows(spark: SparkSession) -> None:
    """Plan joins in this session by the size that tables have in memory, not by that of their files.

    Some ten million rows of ids and short texts may be 10 MB of Parquet, which would be sent to the driver and broadcast. What is
    small in fact is still broadcast: the sizes of shuffles are known as they run.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_FACTOR))


def fresh_folder(spark: SparkSession) -> str:
    """A new name for a table in the shared folder."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


#: Files of a shuffle go when the write that made it ends, not when the driver next collects garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write(df: DataFrame, path: str, *parts: str, mode: str = "error", **conf: str) -> None:
    """Write df as Parquet to path, in folders by `parts`, planned with the settings `conf`; its shuffles are removed from disk."""
    own = df.sparkSession.conf
    want = SHUFFLES_GO | conf
    was = {k: own.get(k, None) for k in want}
    for k, v in want.items():
        own.set(k, v)
    try:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*parts).parquet(path)
    finally:
        for k, v in was.items():
            own.unset(k) if v is None else own.set(k, v)


def durable(df: DataFrame, **conf: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_folder(df.sparkSession)
    write(df, path, **conf)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table or a part of one under the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Remove tables that durable() gave and that nothing reads any more; other frames are left alone."""
    for df in tables:
        if getattr(df, "_folder", None):
            remove(df.sparkSession, df._folder)


#: Rows of one part of a running sum, on average.
PART_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df, of about `rows` rows, by keys over as many parts as those ask for: what follows by these keys takes no more memory as df grows."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // part_rows), *keys)


def running_sum(df: DataFrame, value: str, order: str, out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df with `out`, the sum of value over rows up to this one by falling `order` (unique).

    A prefix scan over ranges of `order`, as many as the rows ask for: sums of the ranges, their offsets, then a window in each.
    """
    df = durable(df)
    parts = 1 + df.count() // part_rows
    ranged = durable(df.repartitionByRange(parts, F.desc(order)).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")  # one row for each range
    own = F.sum(value).over(W.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    joined = ranged.withColumn("_own", own).join(F.broadcast(sums.select("_part", ahead.alias("_ahead"))), "_part")
    return joined.withColumn(out, F.col("_own") + F.col("_ahead")).drop("_part", "_own", "_ahead")
