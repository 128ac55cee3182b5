"""Trace tables ``(keys..., n, x)`` from the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000
HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since the stream's first day."""
    return (F.unix_micros(ts.cast("timestamp")) - EPOCH_US) / F.lit(1e6)


def fill_grid(sums: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Every key with n = 0 .. length - 1, and 0 where there is no sample; one outside is an error."""
    inside = F.col("n").between(0, length - 1)
    sums = sums.withColumn("x", F.when(inside, F.col("x")).otherwise(F.raise_error(F.concat(F.lit(f"sample outside the grid of {length}: "), F.col("n").cast("string")))))
    grid = sums.select(*keys).distinct().withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    return grid.join(sums, [*keys, "n"], "full").withColumn("x", F.coalesce("x", F.lit(0.0)))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tr, n, x): hourly sums of the event values by event type."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(3_600_000_000)).cast("long")
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tr"), hour.alias("n")).agg(F.round(F.sum("value"), 4).alias("x"))
    return fill_grid(sums, ["tr"], HOURS)


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, station, n, x): the same by user and event type."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(3_600_000_000)).cast("long")
    sums = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("component"), F.col("event_type").alias("station"), hour.alias("n")).agg(F.round(F.sum("value"), 4).alias("x"))
    return fill_grid(sums, ["component", "station"], HOURS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, station, n, x): each embedding as a short trace."""
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("station"), F.posexplode("embedding").alias("n", "x")).select("label", "station", F.col("n").cast("long"), F.col("x").cast("double"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, status, n, x): daily revenue by return flag and line status, from each trace's first day on."""
    day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01")).cast("long")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), day.alias("n")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("x"))
    spans = sums.groupBy("flag", "status").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    grid = spans.select("flag", "status", F.explode(F.sequence("a", "b")).alias("n"))
    return grid.join(sums, ["flag", "status", "n"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def picks(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """(tr, t): seconds of the events of one type by user group."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == event_type).select((F.col("user_id") % 10).alias("tr"), (F.col("user_id") % 3).alias("station"), seconds(F.col("ts")).alias("t"))
