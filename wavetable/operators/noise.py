"""Noise levels from order statistics, and what stands out of them.

All levels are windows over (trace, group, frame); only the table of groups
is broadcast, a row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.functions.constants import divide, least_count, least_snr, spread, threshold

#: Added to the level before dividing.
TINY = 1e-8


def dimension(k: Column, bins: int) -> Column:
    """Real components of a bin: one for the first and the last, two for others."""
    return F.when((k == 0) | (k == bins - 1), F.lit(1)).otherwise(F.lit(2))


def in_blocks(cells: DataFrame, groups: list[tuple[int, int]], frame: int, frames: int) -> DataFrame:
    """Adds ``g``, ``b`` and ``d``: frequency group, stationary frame and dimension of each cell."""
    spark = cells.sparkSession
    g = spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(groups)], "g int, k_lo long, k_hi long")
    k = F.broadcast(g.select("g", F.explode(F.sequence("k_lo", "k_hi")).alias("k")))
    b = F.least(F.floor(F.col("m") / max(1, frame)), F.lit(max(1, frames // max(1, frame)) - 1)).cast("int")
    bins = max(z for _, z in groups) + 1
    return cells.where((F.col("m") >= 0) & (F.col("m") < frames)).join(k, "k").withColumn("b", b).withColumn("d", dimension(F.col("k"), bins))


def level(blocks: DataFrame, keys: list[str], rho: float, least: int, branch: str = "high") -> DataFrame:
    """(keys, g, b, n, sigma, xi) of each block of cells with amplitude ``amp``.

    Ascending, s_r is the mean of the first r over lambda, and r crosses if
    y_r <= s_r xi < y_(r+1). ``high``: s at the first crossing from ``least``
    on, else at N - 1; ``low``: else at the last crossing before, else at
    least + 1; ``original``: else at least + 1. With N <= least + 1 the
    fallback is N - 1. ``robust`` takes the first crossing of any rank, else
    the median's.
    """
    by = [*keys, "g", "b"]
    up = Window.partitionBy(*by).orderBy("amp", "k", "m")
    whole = Window.partitionBy(*by)
    lam = F.when(F.col("d") == 1, spread(1)).otherwise(spread(2))
    xi = F.when(F.col("d") == 1, threshold(1, rho)).otherwise(threshold(2, rho))
    r = (
        blocks.withColumn("r", F.row_number().over(up))
        .withColumn("s", F.sum("amp").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.col("r") / lam)
        .withColumn("next", F.lead("amp").over(up))
        .withColumn("n", F.count("*").over(whole))
        .withColumn("xi", xi)
    )
    cross = (F.col("amp") <= F.col("s") * F.col("xi")) & (F.col("s") * F.col("xi") < F.col("next"))
    pick = lambda best, cond: best(F.when(cond, F.col("s")), F.when(cond, F.col("r")))
    first, before = pick(F.min_by, cross & (F.col("r") >= least)), pick(F.max_by, cross & (F.col("r") < least))
    end, small = pick(F.max_by, F.col("r") <= F.greatest(F.lit(1), F.col("n") - 1)), F.max(F.when((F.col("r") == least + 1) & (F.col("n") > least + 1), F.col("s")))
    options = {"high": (first, end), "low": (first, before, small, end), "original": (first, small, end), "robust": (pick(F.min_by, cross), pick(F.max_by, F.col("r") <= F.col("n") / 2), end)}
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(*options[branch]).alias("sigma"), F.min("xi").alias("xi"))


def to_sigma(cells: DataFrame, bins: int, rho: float, eta: str = "eta") -> DataFrame:
    """Adds ``sigma``, the deviation behind a threshold ``eta`` on the amplitude of bin k."""
    xi = F.when(dimension(F.col("k"), bins) == 1, threshold(1, rho)).otherwise(threshold(2, rho))
    return cells.withColumn("sigma", F.col(eta) / xi)


def snr(cells: DataFrame, keys: list[str], groups: list[tuple[int, int]], frame: int, frames: int, rho: float | None, fraction: float = 0.25, branch: str | None = None, big_rho: float = 4.0) -> DataFrame:
    """Cells with ``sigma``, ``snr`` and ``keep``; without ``rho`` it follows from the mean length of the frames' blocks."""
    blocks = in_blocks(cells, groups, frame, frames)
    spans = divide(frames, frame)
    first = spans[0]
    rho = rho or least_snr(sum(z - a for a, z in spans) / len(spans), 2)
    least = least_count(first[1] - first[0] + 1, fraction)
    levels = level(blocks, keys, rho, least, branch or ("high" if rho >= big_rho else "low"))
    out = blocks.join(levels.drop("n"), [*keys, "g", "b"])
    return out.withColumn("snr", F.col("amp") / (F.col("sigma") + TINY)).withColumn("keep", F.col("amp") > F.col("sigma") * F.col("xi")).drop("g", "b", "d", "xi")


def trim(cells: DataFrame, frames: int, edge: int, band: tuple[int, int] | None = None) -> DataFrame:
    """Takes ``keep`` back in the frames at both ends and outside the band."""
    inside = (F.col("m") >= edge) & (F.col("m") < frames - edge - 1)
    if band:
        inside &= (F.col("k") >= band[0]) & (F.col("k") < band[1])
    return cells.withColumn("keep", F.col("keep") & inside)


AGGREGATES = {"any": F.bool_or, "all": F.bool_and, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sum": F.sum, "prod": F.product}


def over_components(cells: DataFrame, keys: list[str], column: str, how: str = "any") -> DataFrame:
    """``column`` aggregated over what is not in ``keys``."""
    return cells.groupBy(*keys).agg(AGGREGATES[how](column).alias(column))


def power_model(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, mean, std) of the power over the given quiet cells."""
    return cells.withColumn("p", F.col("amp") ** 2).groupBy(*keys, "k").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))


def power_score(cells: DataFrame, model: DataFrame, keys: list[str], least: float = 1.0, band: tuple[int, int] | None = None, edge: int = 0, frames: int | None = None, square: bool = False) -> DataFrame:
    """Adds ``z``: deviations of the power above the model, 0 below ``least``, outside the band and at the ends."""
    z = (F.col("amp") ** 2 - F.col("mean")) / (F.col("std") + 1e-16)
    inside = (F.col("k") >= band[0]) & (F.col("k") < band[1]) if band else F.lit(True)
    if frames is not None:
        inside &= (F.col("m") >= edge) & (F.col("m") < frames - edge - 1)
    out = cells.join(model, [*keys, "k"]).withColumn("z", z)
    return out.withColumn("z", F.when(inside & (F.col("z") >= least), F.col("z") ** 2 if square else F.col("z")).otherwise(0.0)).drop("mean", "std")
