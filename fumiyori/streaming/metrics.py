"""Hourly quality metrics and alerts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_metrics(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Count and mean value per kind and window; a late event counts until the watermark passes.

    Works on a streaming and on a batch frame alike; nulls in ``value`` do not count for the mean.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("value"), 6), F.lit(0.0)).alias("avg_value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "avg_value")
    )


def streaming_alerts(events: DataFrame, thresholds: dict[str, tuple[str, float]], width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Windows whose mean value breaks the threshold of their kind."""
    broken = F.lit(False)
    for kind, (op, limit) in thresholds.items():
        value = F.col("avg_value") < limit if op == "<" else F.col("avg_value") > limit
        broken = broken | ((F.col("event_type") == kind) & value)
    return hourly_metrics(events, width, lateness).where(broken)


def run_to_folder(events: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends finished windows as Parquet; the checkpoint makes restarts exact."""
    return hourly_metrics(events).writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).start()
