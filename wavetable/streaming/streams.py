"""Structured Streaming forms: frames as event-time windows, and intervals as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_sums(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(tr, window, x): hourly sums of a stream of events (ts, event_type, value); rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("tr")).agg(F.sum("value").alias("x"))


def frame_energy(samples: DataFrame, keys: list[str], width: str, hop: str, late: str) -> DataFrame:
    """(keys, window, energy): energy of sliding frames of a stream (ts, keys, x)."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width, hop), *keys).agg(F.sum(F.col("x") * F.col("x")).alias("energy"))


def sessions(flags: DataFrame, keys: list[str], gap: str, late: str) -> DataFrame:
    """(keys, session, n): detections (ts, keys) joined while they are closer than ``gap``."""
    return flags.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
