"""Streaming forms of the period, session and first-row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counts_per_window(events: DataFrame, ts: str, by: str, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per tumbling or sliding window; rows later than the watermark are dropped."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return t.groupBy(F.window(ts, size, slide or size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, actor: str, gap: str = "180 days 23 hours 59 minutes 59.999999 seconds", late: str = "1 hour") -> DataFrame:
    """Activity periods; the default gap is the batch rule's 'more than 180 whole days'."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return t.groupBy(F.session_window(ts, gap), actor).agg(F.count("*").alias("n")).select(actor, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_rows(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Process what is there and stop; restarts go on from the checkpoint."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
