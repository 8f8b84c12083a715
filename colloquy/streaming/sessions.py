"""Structured Streaming forms of the event and session operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind; rows later than the watermark are dropped by a stream and counted by a batch."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def first_deliveries(turns: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each turn once within the watermark (the streaming form of the repeated-utterance test)."""
    return turns.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
