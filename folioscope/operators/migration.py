"""A change of embedding model, or a long sync, that may be cut off: a staged table with progress that takes the cache's place when whole.

What must be embedded is written once as numbered files; a stream takes some of them a time, sends their texts to the
model in batches on the executors, and adds the vectors to the staged table. Its checkpoint says which files are done, so that a
migration that was cut off asks the model for the rest only. Until the last file is done, readers keep the cache that was there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import vectors

#: Passages that a file of the plan holds, and files that one step of the stream takes.
FILE_PASSAGES, STEP_FILES = 512, 8
KEYS = "passage_id string, sha256 string, embedded_text_sha256 string"
CACHE = f"{KEYS}, model string, dimensions int, vector array<double>"
POINTER = "number long, folder string, model string, dimensions int"


class Cancelled(Exception):
    """The caller asked to stop; what is staged stays, and migrate() goes on from there."""


@dataclass(frozen=True)
class Progress:
    total: int
    done: int

    @property
    def whole(self) -> bool:
        return self.done == self.total


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def current(spark: SparkSession, home: str) -> DataFrame:
    """The cache that readers use: the one that the newest pointer names, or an empty one."""
    if not exists(spark, f"{home}/pointer"):
        return spark.createDataFrame([], CACHE)
    newest = spark.read.schema(POINTER).parquet(f"{home}/pointer").orderBy(F.desc("number")).first()
    return spark.read.schema(CACHE).parquet(newest["folder"])


def planned(passages: DataFrame, cache: DataFrame, stage: str, model: str, dimensions: int) -> None:
    """Writes what the model must be asked for, and the vectors that stay; the second marks a plan as complete."""
    keys = ["passage_id", "sha256", "embedded_text_sha256"]
    missing = passages.join(vectors.to_embed(passages, cache, model, dimensions), "passage_id", "left_semi").select(*keys, "embedded_text")
    missing.write.mode("overwrite").option("maxRecordsPerFile", FILE_PASSAGES).parquet(f"{stage}/plan")
    right = cache.where((F.col("model") == model) & (F.col("dimensions") == dimensions) & (F.size("vector") == dimensions))
    kept = right.join(passages.select(*keys), keys, "left_semi").select(*keys, "model", "dimensions", F.col("vector").cast("array<double>").alias("vector"))
    kept.write.mode("overwrite").parquet(f"{stage}/kept")


def progress(spark: SparkSession, stage: str) -> Progress:
    total = spark.read.schema(f"{KEYS}, embedded_text string").parquet(f"{stage}/plan").count()
    done = spark.read.schema(CACHE).parquet(f"{stage}/made").count() if exists(spark, f"{stage}/made") else 0
    return Progress(total, done)


def migrate(passages: DataFrame, home: str, stage: str, embed: vectors.Embedder, model: str, dimensions: int, size: int = 16, stop: Callable[[Progress], bool] = lambda _: False, step_files: int = STEP_FILES) -> Progress:
    """Brings the cache below ``home`` to a model and to passages (passage_id, sha256, embedded_text_sha256, embedded_text).

    ``stage`` is a folder of this migration: called again with it, after a failure or a cancellation, the migration goes on
    with the plan that is there. ``stop`` is asked before each step and cancels; ``embed`` gets ``size`` texts at a time. A step that
    failed is done again and overwrites what it had written. The pointer is moved last; a migration without anything to ask for
    moves it too, so that entries of passages that are gone fall away.
    """
    spark = passages.sparkSession
    if not exists(spark, f"{stage}/kept"):
        planned(passages, current(spark, home), stage, model, dimensions)
    schema = f"{KEYS}, embedded_text string"
    none = spark.createDataFrame([], CACHE)

    def step(rows: DataFrame, number: int) -> None:
        if stop(progress(spark, stage)):
            raise Cancelled(f"before step {number}")
        vectors.synced(rows, none, embed, model, dimensions, size).write.mode("overwrite").parquet(f"{stage}/made/step={number}")

    total = progress(spark, stage)
    if not total.whole:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", step_files).parquet(f"{stage}/plan")
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{stage}/state").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            if "Cancelled" in str(e):
                raise Cancelled(str(progress(spark, stage))) from e
            raise
    done = progress(spark, stage)
    if not done.whole:
        raise RuntimeError(f"{done.done} of {done.total} passages are staged")
    made = spark.read.schema(CACHE).parquet(f"{stage}/made").select(none.columns) if done.total else none
    made.unionByName(spark.read.schema(CACHE).parquet(f"{stage}/kept")).write.mode("overwrite").parquet(f"{stage}/whole")
    last = spark.read.schema(POINTER).parquet(f"{home}/pointer").agg(F.max("number")).first()[0] if exists(spark, f"{home}/pointer") else 0
    spark.createDataFrame([(last + 1, f"{stage}/whole", model, dimensions)], POINTER).coalesce(1).write.mode("append").parquet(f"{home}/pointer")
    return done
