"""Live velocity: windowed counts with watermarks, and decisions by joining the stream to standing risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators.rules import inline_decisions


def event_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """A stream of the folder's files with ts as an event time that watermarks accept."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def velocity(events: DataFrame, key: str = "user_id", window: str = "30 minutes", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Events and value by key and window; late events count until the watermark passes. late: None keeps the stream's own
    watermark, as after once()."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), key, "n", "value")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), key, "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, however often it arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def decide(transactions: DataFrame, risk: DataFrame) -> DataFrame:
    """Inline decisions on a stream of ledger rows; risk is a table, read anew with each micro-batch."""
    return inline_decisions(transactions, risk)
