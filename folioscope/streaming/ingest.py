"""Incremental ingestion and job state as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folioscope.operators.workflow import ATTEMPTS


def read_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder as a stream, with the schema of those already there."""
    schema = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(documents: DataFrame, key: str = "sha256") -> DataFrame:
    """The first row of each content hash, across all batches."""
    return documents.dropDuplicates([key])


def job_states(events: DataFrame) -> DataFrame:
    """(job, done, attempts) of each job with new events (job, kind), in update mode; status() reads the state from the last row."""
    return events.groupBy("job").agg(F.max(F.col("kind") == "purchase").alias("done"), F.count_if(F.col("kind") == "error").alias("attempts"))


def status(done: Column, attempts: Column) -> Column:
    return F.when(attempts >= ATTEMPTS, "blocked").when(done, "ready").otherwise("waiting")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream, into a Parquet table below folder; ``batch`` says which batch wrote a row.

    A batch that is tried again overwrites what it wrote before.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", IntegerType())).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window with a watermark; an extension for event tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))
