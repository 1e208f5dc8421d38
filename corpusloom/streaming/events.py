"""Structured Streaming over the events: an extension, as the data has no stream of its own.

Every function takes a streaming (or batch) frame of event_id, ts, user_id,
event_type, value and gives a frame; sinks are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_only(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of each id; state older than the watermark goes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events and value per window and type; late beyond the watermark is left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: events closer than `gap`."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", delay).groupBy("user_id", w).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "events", "value")


def rate_limited(events: DataFrame, seconds: float) -> DataFrame:
    """event_id and the earliest time it may be sent: per user, slots at least `seconds` apart, reserved in order."""

    def slots(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0.0
        for part in parts:
            part = part.sort_values(["ts", "event_id"])
            out = []
            for event, ts in zip(part["event_id"], part["ts"].map(pd.Timestamp.timestamp), strict=True):
                at = max(free, ts)
                free = at + seconds
                out.append((key[0], event, at))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "slot"])
        state.update((free,))

    return events.groupBy("user_id").applyInPandasWithState(slots, "user_id long, event_id long, slot double", "free double", "append", GroupStateTimeout.NoTimeout)
