"""Splitting clusters into phases by persistence or by a spline.

Both work on one cluster at a time, as its cells are few next to a trace's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project(cells: DataFrame, keys: list[str], e: str = "amp", how: str = "rel_mean") -> DataFrame:
    """(keys, cluster_id, m, curve): energy on time, the largest or the sum over the cluster's bandwidth, its maximum 1."""
    by = [*keys, "cluster_id"]
    per = cells.groupBy(*by, "m").agg((F.max(e) if how == "max" else F.sum(e)).alias("curve"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    value = F.col("curve") if how == "max" else F.col("curve") / F.max("_n").over(whole)
    per = per.withColumn("curve", value)
    return per.withColumn("curve", F.col("curve") / F.max("curve").over(whole)).drop("_n")


def period(cells: DataFrame, keys: list[str], df: float, dt: float, e: str = "amp", how: str = "centroid") -> DataFrame:
    """(keys, cluster_id, period): of the centroid or the peak frequency, or the deviation in time about the centroid."""
    f, t, w = F.col("k") * F.lit(df), F.col("m") * F.lit(dt), F.col(e)
    top = F.max(F.struct(F.col(e), (-F.col("k")).alias("k")))
    value = {"centroid": F.try_divide(F.sum(w), F.sum(f * w)), "peak": F.try_divide(F.lit(1.0), -top["k"] * F.lit(df)), "time": F.sqrt(F.sum(w * t * t) / F.sum(w) - (F.sum(w * t) / F.sum(w)) ** 2)}[how]
    return cells.groupBy(*keys, "cluster_id").agg(value.alias("period"))


def smooth(cells: DataFrame, keys: list[str], reach: tuple[int, int], e: str = "amp") -> DataFrame:
    """The energies as means over the cells within ``reach`` in the cluster."""
    by = [*keys, "cluster_id"]
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach[0], reach[0] + 1) for b in range(-reach[1], reach[1] + 1))))
    moved = cells.select(*by, "k", "m", F.col(e).alias("_e"), moves.alias("_s")).select(*by, (F.col("k") + F.col("_s.a")).alias("k"), (F.col("m") + F.col("_s.b")).alias("m"), "_e")
    mean = moved.groupBy(*by, "k", "m").agg(F.avg("_e").alias("_mean"))
    return cells.join(mean, [*by, "k", "m"]).withColumn(e, F.col("_mean")).drop("_mean")


def largest_gap(prominence: np.ndarray, least: int = 1, most: int | None = None) -> float:
    """The prominence under the widest gap between sorted ones, with ``least`` to ``most`` values above."""
    p = np.sort(prominence)[::-1]
    most = min(most or len(p), len(p))
    if most <= least:
        return float(p[most - 1])
    gap = p[least - 1 : most] - np.append(p, 0.0)[least : most + 1]
    return float(p[least - 1 + int(np.argmax(gap))])


def persistence(value: np.ndarray, place: np.ndarray, reach: tuple[int, ...], least: float, octaves: float | None = None) -> tuple[np.ndarray, dict[int, float]]:
    """(basin of each point, prominence of each peak): a watershed from above; basins that meet merge while the lower peak stands out by less than ``least``.

    The base level is 0, so the highest peak's prominence is its value.
    Points of value 0 or less belong to no basin (-1). ``octaves`` replaces
    the reach in the first dimension by a ratio, of one place at least.
    """
    order = np.lexsort((*place.T[::-1], -value))
    at = {tuple(p): i for i, p in enumerate(place.tolist())}
    moves = [m for m in np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in reach], indexing="ij"), -1).reshape(-1, len(reach)).tolist() if any(m)]
    up, prominence = np.full(len(value), -1), {}

    def near(p: list[int]) -> list[tuple]:
        if octaves is None:
            return [tuple(a + b for a, b in zip(p, m, strict=True)) for m in moves]
        ks = range(min(p[0] - 1, round(p[0] * 2**-octaves)), max(p[0] + 1, round(p[0] * 2**octaves)) + 1)
        return [q for k in ks for m in range(p[1] - reach[1], p[1] + reach[1] + 1) if (q := (k, m)) != tuple(p)]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in order.tolist():
        if value[i] <= 0:
            continue
        around = [j for q in near(place[i].tolist()) if (j := at.get(q)) is not None and up[j] >= 0]
        if not around:
            up[i], prominence[i] = i, float(value[i])
            continue
        home = top(max(around, key=lambda j: (value[j], -j)))
        up[i] = home
        for j in around:
            a, b = top(home), top(j)
            if a == b:
                continue
            low, high = (a, b) if (value[a], -a) < (value[b], -b) else (b, a)
            if value[low] - value[i] < least:
                up[low] = high
            prominence[low] = min(prominence[low], float(value[low] - value[i]))
    return np.array([top(i) if up[i] >= 0 else -1 for i in range(len(value))]), prominence


def split_persistent(cells: DataFrame, keys: list[str], reach: tuple[int, int] = (1, 1), least: float | None = None, e: str = "amp", most: int | None = None, octaves: float | None = None) -> DataFrame:
    """(keys, cluster_id, k, m, phase): basins of the energy on the plane, from 0 by their first frame."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value, place = pdf[e].to_numpy(float), pdf[["k", "m"]].to_numpy(np.int64)
        bar = least
        if bar is None:
            _, prominence = persistence(value, place, reach, 0.0, octaves)
            bar = largest_gap(np.array(list(prominence.values())), 1, most) if prominence else 0.0
        basin, _ = persistence(value, place, reach, bar, octaves)
        names = pd.DataFrame({"b": basin, "m": pdf["m"]}).groupby("b")["m"].min().reset_index().sort_values(["m", "b"])
        number = {b: n for n, b in enumerate(names.loc[names.b >= 0, "b"])}
        return pdf.drop(columns=[e]).assign(phase=[number.get(b, -1) for b in basin])

    by = [*keys, "cluster_id", "k", "m"]
    return cells.select(*by, e).groupBy(*keys, "cluster_id").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "phase long"]))


def natural_spline(y: np.ndarray) -> np.ndarray:
    """Coefficients (n - 1, 4) of the natural cubic spline through y at 0, 1, ..., highest power first."""
    n = len(y)
    a = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    a[0, :2], a[-1, -2:] = [1, 0], [0, 1]
    rhs = np.zeros(n)
    rhs[1:-1] = 6 * np.diff(y, 2)
    c = np.linalg.solve(a, rhs)
    d = np.diff(y)
    return np.stack([np.diff(c) / 6, c[:-1] / 2, d - (2 * c[:-1] + c[1:]) / 6, y[:-1]], axis=1)


def valleys(y: np.ndarray) -> list[tuple[float, float, float]]:
    """(peak place, border to its left, prominence) of the spline's maxima in order; the border is the minimum between neighbours."""
    out, lows, last = [], [(0.0, float(y[0]))], None
    for i, (a, b, c, d) in enumerate(natural_spline(y)):
        roots = np.roots([3 * a, 2 * b, c]) if abs(a) > 1e-14 else np.array([-c / (2 * b)]) if abs(b) > 1e-14 else np.array([])
        for r in sorted(x.real for x in roots if abs(x.imag) < 1e-12 and 0 <= x.real < 1):
            height = ((a * r + b) * r + c) * r + d
            if 6 * a * r + 2 * b < 0:
                border = min((x for x in lows if last is None or x[0] >= last), key=lambda x: x[1], default=(i + r, height))
                out.append((i + r, border[0], height - border[1]))
                last = i + r
            else:
                lows.append((i + r, height))
    return out


def split_spline(cells: DataFrame, keys: list[str], e: str = "amp", how: str = "rel_mean", least: float | None = None, min_width: float = 0.0, most: int | None = None) -> DataFrame:
    """(keys, cluster_id, m, phase): phases between the borders of the time projection's spline.

    Phases that are short or not prominent join the stronger neighbour, and
    beyond ``most`` only the most prominent keep their border. Clusters of
    fewer than five frames are one phase.
    """
    curve = project(cells, keys, e, how)
    kinds = {f.name: f.dataType.simpleString() for f in curve.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        m = pdf["m"].to_numpy()
        y = np.zeros(m[-1] - m[0] + 1)
        y[m - m[0]] = pdf["curve"]
        borders: list[float] = []
        if len(y) >= 5 and (found := valleys(y)):
            strong = np.array([p for *_, p in found])
            bar = largest_gap(strong, 1, most) if least is None else least
            start = np.array([b for _, b, _ in found])
            width = np.diff(np.append(start, len(y) - 1))
            alive = [i for i in range(len(found)) if strong[i] >= bar and width[i] >= min_width]
            alive = sorted(sorted(alive, key=lambda i: -strong[i])[: most or len(alive)])
            borders = start[alive][1:].tolist()
        return pdf.drop(columns=["curve"]).assign(phase=np.searchsorted(borders, m - m[0], "right"))

    by = [*keys, "cluster_id", "m"]
    return curve.groupBy(*keys, "cluster_id").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "phase long"]))


def bases(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place up to each that no higher value cuts off, the least value from there on); one pass with a stack."""
    start, least, stack = np.empty(len(y), np.int64), np.empty(len(y)), []
    for i, v in enumerate(y.tolist()):
        low = v
        while stack and y[stack[-1]] <= v:
            low = min(low, least[stack.pop()])
        start[i], least[i] = stack[-1] + 1 if stack else 0, low
        stack.append(i)
    return start, least


def peaks(curve: DataFrame, keys: list[str], value: str, at: str = "n", height: float | None = None, prominence: float | None = None, width: float | None = None) -> DataFrame:
    """(keys, at, value, prominence, width): local maxima with their prominence and their width at half of it.

    Candidates are found by neighbours' values; their prominence needs the
    whole curve, so a trace's curve meets in one call, in time that grows with
    its length and the widths of its peaks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in curve.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at).reset_index(drop=True)
        y, rows = pdf[value].to_numpy(float), []
        start, left = bases(y)
        end, right = bases(y[::-1])
        end, right = len(y) - end[::-1], right[::-1]
        inner = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1 if len(y) > 2 else np.zeros(0, np.int64)
        for i in inner[y[inner] >= height].tolist() if height is not None else inner.tolist():
            p = y[i] - max(left[i], right[i])
            bar, a, b = y[i] - p / 2, i, i
            while a > start[i] and y[a - 1] >= bar:
                a -= 1
            while b + 1 < end[i] and y[b + 1] >= bar:
                b += 1
            if (prominence is None or p >= prominence) and (width is None or b - a + 1 >= width):
                rows.append((i, p, float(b - a + 1)))
        kept = pdf.iloc[[r[0] for r in rows]].copy()
        return kept.assign(prominence=[r[1] for r in rows], width=[r[2] for r in rows])

    cols = [*keys, at, value]
    return curve.select(*cols).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in cols), "prominence double, width double"]))
