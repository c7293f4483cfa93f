"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream, with an event time that watermarks can use.

    What is there now is one batch: the watermark moves between batches, and files need not be in order of time.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema)
    source = rows.parquet(path) if _is_folder(spark, path) else rows.option("pathGlobFilter", name).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream yields from what is there now, through a parquet sink with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    out = f"{staging(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def daily_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Windows of a day by type; a window is final once the watermark passes its end."""
    days = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type")
    return days.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def first_of_each(events: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """Rows without repeats of a key while it is within the watermark: an idempotent queue."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a key's events, none later than `gap` after the one before; just `gap` later still belongs."""
    runs = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key)
    return runs.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")
