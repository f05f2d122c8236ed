"""The folder that driver and executors share: checkpoints, and tables that later steps read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, a temporary one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if known.isDefined():
        return named or known.get()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="folioscope-")
    sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that only its writer reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def transient_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each write go when it ends; otherwise they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and reread from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in a total order.

    Rows are dealt into ranges of the order and numbered inside them; only the ranges' row counts are added up, so no
    task sees all rows.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": place}))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), "_part").withColumn(rank, F.col("_first") + F.col("_place") + 1).drop("_part", "_place", "_first")
