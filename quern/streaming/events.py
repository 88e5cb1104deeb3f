"""Windows over event logs: the same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of windows of equal width; a stream needs ``late``, how late an event may come."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of each user's runs of events less than ``gap`` apart; the end is the last event's and the gap."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines appended to a folder."""
    return spark.readStream.schema(EVENT).json(folder)
