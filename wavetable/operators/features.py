"""The catalog: one row for each cluster, features as aggregates.

A feature is a function from parameters to a list of named columns, so user
features are columns too; those beyond columns go through ``custom``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extent(dt: float, df: float, e: str = "amp", snr: str = "snr") -> list[Column]:
    """Bounds, peak and sums; the first cell in the order of (k, m) wins a tie for the peak."""
    m = F.col("m").cast("double")
    t = m * dt
    half = t / (m + 1) / 2
    peak = F.max(F.struct(F.col(e).alias("e"), (-F.col("k")).alias("k"), (-F.col("m")).alias("m")))
    return [
        F.min(t - half).alias("time_start"), F.max(t + half).alias("time_end"), (-peak["m"] * F.lit(dt)).alias("time_peak"),
        F.min(F.col("k") * F.lit(df)).alias("frequency_start"), F.max(F.col("k") * F.lit(df)).alias("frequency_end"), (-peak["k"] * F.lit(df)).alias("frequency_peak"),
        F.max(e).alias("energy_peak"), F.avg(e).alias("energy_mean"), F.sum(e).alias("energy_sum"),
        F.sum(snr).alias("snr_sum"), F.avg(snr).alias("snr_mean"), F.max(snr).alias("snr_peak"),
    ]


def energy_statistics(e: str = "amp") -> list[Column]:
    """Minimum to entropy of the energies; skewness and kurtosis without bias, null for too few cells or no spread."""
    v, n = F.col(e), F.count(e)
    g1, g2 = F.skewness(e), F.kurtosis(e)
    flat = F.stddev_pop(e) > 0
    total = F.sum(e)
    return [
        F.min(v).alias("e_min"), F.max(v).alias("e_max"), F.avg(v).alias("e_mean"), F.stddev_samp(v).alias("e_std"),
        F.when((n > 2) & flat, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("e_skew"),
        F.when((n > 3) & flat, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("e_kurtosis"),
        (F.exp(F.avg(F.ln(v))) / F.avg(v)).alias("e_flatness"),
        (F.ln(total) - F.sum(v * F.ln(v)) / total).alias("e_entropy"),
    ]


def catalog(cells: DataFrame, keys: list[str], features: list[Column]) -> DataFrame:
    """One row for each (keys, cluster_id)."""
    return cells.groupBy(*keys, "cluster_id").agg(*features)


def custom(cells: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """Features from a function of a cluster's pandas frame, one cluster a call."""
    return cells.groupBy(*keys, "cluster_id").applyInPandas(function, schema)


def combine_components(cells: DataFrame, keys: list[str], value: str, how: str = "l2") -> DataFrame:
    """``value`` of (keys, k, m) over components: the root of the sum of squares, or the maximum."""
    agg = F.sqrt(F.sum(F.col(value) ** 2)) if how == "l2" else F.max(value)
    return cells.groupBy(*keys, "k", "m").agg(agg.alias(value))


def moments(cells: DataFrame, keys: list[str], dt: float, df: float, e: str = "amp", order: int = 4) -> DataFrame:
    """m00, centroids m10 (frequency) and m01 (time), and central moments over m00 up to the order."""
    by = Window.partitionBy(*keys, "cluster_id")
    f, t, w = F.col("k") * F.lit(df), F.col("m") * F.lit(dt), F.col(e)
    c = cells.withColumn("_f", F.sum(w * f).over(by) / F.sum(w).over(by)).withColumn("_t", F.sum(w * t).over(by) / F.sum(w).over(by))
    fine = [F.sum(w).alias("m00"), F.first("_f").alias("m10"), F.first("_t").alias("m01")]
    for i in range(order + 1):
        for j in range(order + 1 - i):
            if i + j >= 2:
                term = w
                for _ in range(i):
                    term = term * (f - F.col("_f"))
                for _ in range(j):
                    term = term * (t - F.col("_t"))
                fine.append((F.sum(term) / F.sum(w)).alias(f"m{i}{j}"))
    return c.groupBy(*keys, "cluster_id").agg(*fine)


def shape(table: DataFrame) -> DataFrame:
    """Deviation, skewness, kurtosis, covariance and ellipse from moments up to order 4; null where an axis has no spread."""
    f2, t2, ft = F.col("m20"), F.col("m02"), F.col("m11")
    root = F.sqrt(4 * ft * ft + (f2 - t2) * (f2 - t2))
    l1, l2 = (f2 + t2 + root) / 2, (f2 + t2 - root) / 2
    return table.withColumns(
        {
            "f_std": F.sqrt(f2), "t_std": F.sqrt(t2), "covariance": ft,
            "f_skew": F.when(f2 > 0, F.col("m30") / (f2 * F.sqrt(f2))), "t_skew": F.when(t2 > 0, F.col("m03") / (t2 * F.sqrt(t2))),
            "f_kurtosis": F.when(f2 > 0, F.col("m40") / (f2 * f2)), "t_kurtosis": F.when(t2 > 0, F.col("m04") / (t2 * t2)),
            "angle": F.atan2(2 * ft, f2 - t2) / 2, "eccentricity": F.when(l1 > 0, F.sqrt(1 - (l2 / l1) * (l2 / l1))),
        }
    )


def polynomial(cells: DataFrame, keys: list[str], dt: float, df: float, order: int = 1, e: str = "amp", octaves: bool = False, low: float = 1e-3) -> DataFrame:
    """(keys, cluster_id, c0, ..., c{order}): each cluster's frequency as a polynomial of its time, by least squares.

    Residuals are multiplied by the energy, so its square is their weight. The
    time runs from -1 at the cluster's first frame to 1 at its last, which is
    the domain of the coefficients. ``octaves`` takes the binary logarithm of
    the frequency, with ``low`` in place of 0. Clusters with no more cells
    than ``order``, or with fewer frames than coefficients, have nulls. Only
    sums of powers leave the clusters, and a row for each is solved in Arrow.
    """
    f = F.col("k") * F.lit(df)
    f = F.log2(F.when(f == 0, low).otherwise(f)) if octaves else f
    by = [*keys, "cluster_id"]
    whole = Window.partitionBy(*by)
    first, last = F.min("m").over(whole), F.max("m").over(whole)
    w = (F.col(e) / F.max(e).over(whole)) ** 2
    u = F.try_divide(2.0 * (F.col("m") - first), last - first) - 1
    sums = cells.select(*by, f.alias("_f"), w.alias("_w"), u.alias("_u"), "m").groupBy(*by).agg(
        F.array(*(F.sum(F.col("_w") * F.pow("_u", F.lit(j))) for j in range(2 * order + 1))).alias("s"),
        F.array(*(F.sum(F.col("_w") * F.col("_f") * F.pow("_u", F.lit(j))) for j in range(order + 1))).alias("t"),
        F.count("*").alias("n"), F.count_distinct("m").alias("frames"),
    )
    names = [f"c{j}" for j in range(order + 1)]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, order + 1), np.nan)
            for i, (s, t, n, frames) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("s", "t", "n", "frames")), strict=True)):
                if n > order and frames > order:
                    out[i] = np.linalg.solve(np.array([s[j : j + order + 1] for j in range(order + 1)]), t)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(c, from_pandas=True) for c in out.T)], names=[*by, *names])

    kinds = {c.name: c.dataType.simpleString() for c in sums.schema.fields}
    return sums.mapInArrow(solve, ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{c} double" for c in names)]))


def arrival(cells: DataFrame, keys: list[str], dt: float, e: str = "amp", mode: str = "first_valley") -> DataFrame:
    """(keys, cluster_id, arrival): at the peak's bin, the cluster's start or the first valley left of the peak."""
    by = Window.partitionBy(*keys, "cluster_id")
    peak = F.max(F.struct(F.col(e).alias("e"), (-F.col("k")).alias("k"), (-F.col("m")).alias("m"))).over(by)
    row = cells.withColumn("_p", peak).where(F.col("k") == -F.col("_p.k"))
    if mode == "cluster_start":
        return row.groupBy(*keys, "cluster_id").agg((F.min("m") * F.lit(dt)).alias("arrival"))
    row = row.where(F.col("m") <= -F.col("_p.m"))
    left = F.lag(e).over(Window.partitionBy(*keys, "cluster_id").orderBy("m"))
    row = row.withColumn("_left", left)
    # Going left, the first cell whose left neighbour is not lower; else the leftmost.
    stop = F.max(F.when(F.col("_left") >= F.col(e), F.col("m")))
    return row.groupBy(*keys, "cluster_id").agg((F.coalesce(stop, F.min("m")) * F.lit(dt)).alias("arrival"))


UNITS = {"time_start": "sec", "time_end": "sec", "time_peak": "sec", "frequency_start": "hz", "frequency_end": "hz", "frequency_peak": "hz"}


def with_units(table: DataFrame, units: dict[str, str] = UNITS) -> DataFrame:
    """Columns renamed with their units, once."""
    return table.withColumnsRenamed({c: f"{c}_{u}" for c, u in units.items() if c in table.columns})


def merge_catalogs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on (keys, cluster_id); columns in both get _old and _new."""
    on = [*keys, "cluster_id"]
    both = set(old.columns) & set(new.columns) - set(on)
    return old.withColumnsRenamed({c: f"{c}_old" for c in both}).join(new.withColumnsRenamed({c: f"{c}_new" for c in both}), on, "full_outer")


def append(first: DataFrame, second: DataFrame, keys: list[str], shift: float, times: list[str]) -> DataFrame:
    """Both catalogs; the second's times move by ``shift`` and its ids follow the first's in each trace."""
    top = first.groupBy(*keys).agg(F.max("cluster_id").alias("_top"))
    moved = second.join(top, keys, "left").withColumn("cluster_id", F.col("cluster_id") + F.coalesce("_top", F.lit(0))).drop("_top")
    return first.unionByName(moved.withColumns({c: F.col(c) + shift for c in times}))


def likelihood(cells: DataFrame, keys: list[str], value: str = "snr") -> DataFrame:
    """(keys, m, likelihood): the value summed over the bins of the cells given."""
    return cells.groupBy(*keys, "m").agg(F.sum(value).alias("likelihood"))


def best(rows: DataFrame, keys: list[str], value: str, order: list[str], k: int = 1) -> DataFrame:
    """The k rows of each key with the largest value, ties by ``order``."""
    by = Window.partitionBy(*keys).orderBy(F.desc(value), *order)
    return rows.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
