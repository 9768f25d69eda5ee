"""Written intermediate tables: cut lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder on a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        folder = os.path.join(tempfile.gettempdir(), "siltstone-stage")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str, **observed) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The table survives the loss of executors, and later plans start from it.
    With ``observed`` (names and aggregates) the result has an attribute ``seen``
    with their values, which come with the write and cost no job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation() if observed else None
    watched = df.observe(seen, *(e.alias(k) for k, e in observed.items())) if observed else df
    watched.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.path, out.seen = path, (seen.get if seen else {})
    return out


def together(parts: list[DataFrame]) -> DataFrame:
    """The rows of several staged tables of one schema as a single scan, however many they are."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p.path for p in parts))


def is_staged(df: DataFrame) -> bool:
    """Whether a staged table is still there for plans to read."""
    return any(p == getattr(df, "path", None) for _, p in _written)


def release(spark: SparkSession) -> None:
    """Delete all tables staged by this session so far; no plan may read them any more."""
    global _written
    mine, _written = [p for s, p in _written if s is spark], [(s, p) for s, p in _written if s is not spark]
    for path in mine:
        _delete(spark, path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are cores, else unchanged.

    For small tables in one file before a Python operator; a large table has
    more splits than cores and is never shuffled by this.  Hashed by ``key``, so
    a task that runs again gets the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in a total order, no task seeing more than a range of it.

    Rows are split by ranges of the order, numbered within each, and shifted by
    the sizes of the ranges before (a table of a row per partition).
    """
    parts = stage(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.broadcast(sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("shift_")))
    place = F.col("shift_") + F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return parts.join(shift, "part_").withColumn(name, place).drop("part_", "shift_")


def drop(df: DataFrame) -> None:
    """Delete a staged table which no later plan reads."""
    for path in df.inputFiles()[:1]:
        _delete(df.sparkSession, path.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            continue
