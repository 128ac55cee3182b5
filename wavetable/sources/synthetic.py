"""Synthetic traces with tone bursts at known times, made on the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bursts(spark: SparkSession, components: int = 3, stations: int = 8, length: int = 4000, dt: float = 0.005, at: tuple[float, ...] = (7.0, 14.0), hertz: float = 10.0, seconds: float = 0.6, delay: float = 0.02, noise: float = 0.1, hum: float = 50.0, seed: int = 7) -> DataFrame:
    """(component, station, n, x): noise, a hum, and tapered bursts that reach each station ``delay`` later."""
    base = spark.range(components * stations * length).select(
        F.floor(F.col("id") / (stations * length)).cast("int").alias("component"), (F.floor(F.col("id") / length) % stations).cast("int").alias("station"), (F.col("id") % length).alias("n")
    )
    t = F.col("n") * dt
    x = F.randn(seed) * noise + 0.1 * F.sin(t * (2 * math.pi * hum))
    for start in at:
        u = (t - start - F.col("station") * delay) / seconds
        x = x + F.when((u >= 0) & (u < 1), F.pow(F.sin(u * math.pi), 2) * F.sin(t * (2 * math.pi * hertz))).otherwise(0.0)
    return base.withColumn("x", x)
