"""Moving averages, and intervals as gaps and islands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.operators.transform import CHUNK, chunks, filled, repeated, schema_of

#: Width of a bucket in joins of intervals with places, and with seconds.
PLACES, SECONDS = 64, 3600.0


def characteristic(x: Column, kind: str = "square") -> Column:
    return x * x if kind == "square" else F.abs(x)


def window_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums of each ``size`` samples in a row, from the sums up to and from the borders of blocks; nothing is subtracted."""
    many = len(x) - size + 1
    blocks = np.concatenate([x, np.zeros(-len(x) % size)]).reshape(-1, size)
    upto, onward = np.cumsum(blocks, axis=1).ravel(), np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(many)
    return np.where(start % size == 0, onward[:many], onward[:many] + upto[size - 1 : size - 1 + many])


def _ratios(batches: Iterable[pa.RecordBatch], keys: list[str], long: int, short: int, overlap: int, chunk: int) -> Iterator[pa.RecordBatch]:
    left = long - overlap
    for batch in batches:
        at, found = [], []
        for _, c, n, v in filled(batch, chunk + left + max(short, overlap) - 1):
            many = min(chunk, n - c * chunk)
            at.append(c * chunk + np.arange(many))
            found.append(window_sums(v[left:], short)[:many] / (window_sums(v, long)[:many] + 1e-16) * (long / short))
        if found:
            yield pa.RecordBatch.from_arrays([*repeated(batch, keys, list(map(len, at))), pa.array(np.concatenate(at)), pa.array(np.concatenate(found))], names=[*keys, "n", "ratio"])


def sta_lta(traces: DataFrame, keys: list[str], long: int, short: int, overlap: int = 1, step: int = 1, kind: str = "square") -> DataFrame:
    """(keys, n, ratio): the mean of the next ``short`` samples over that of the last ``long``, reflected at the ends.

    Chunks of a trace come with the samples before and after that they need,
    so no task holds a trace.
    """
    left, chunk = long - overlap, CHUNK
    cut = chunks(traces.withColumn("x", characteristic(F.col("x"), kind)), keys, left, chunk + left + max(short, overlap) - 1, chunk, F.ceil(F.col("_size") / chunk))
    out = cut.mapInArrow(lambda it: _ratios(it, keys, long, short, overlap, chunk), schema_of(traces, keys, "n long, ratio double"))
    return out.where(F.col("n") % step == 0) if step > 1 else out


def islands(flags: DataFrame, keys: list[str], at: str = "n") -> DataFrame:
    """(keys, start, end) of the runs of consecutive places in ``flags``, which has only true ones."""
    by = Window.partitionBy(*keys).orderBy(at)
    run = F.col(at) - F.row_number().over(by)
    return flags.select(*keys, at).distinct().withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("_run")


def merge(intervals: DataFrame, keys: list[str], gap, least=0) -> DataFrame:
    """(keys, interval_id, start, end): intervals closer than ``gap`` joined, shorter than ``least`` dropped; overlapping ones join too."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") - before >= gap)) if gap > 0 else (before.isNull() | (F.col("start") > before))
    joined = intervals.withColumn("_new", new.cast("int")).withColumn("_id", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy(*keys, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= least)
    return out.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).cast("long").alias("interval_id"), "start", "end")


def hulls(labels: DataFrame, keys: list[str], at: str = "m") -> DataFrame:
    """(keys, interval_id, start, end): from each cluster's first to its last place, united where they touch."""
    spans = labels.groupBy(*keys, "cluster_id").agg(F.min(at).alias("start"), F.max(at).alias("end"))
    return merge(spans.drop("cluster_id"), keys, 2)


def raster(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the places that integer intervals cover."""
    return intervals.select(*keys, F.explode(F.sequence("start", "end")).alias("n")).distinct()


def from_curve(curve: DataFrame, keys: list[str], value: str, level: float, gap: int, least: int = 0, at: str = "n") -> DataFrame:
    """Merged intervals where the curve is above the level."""
    return merge(islands(curve.where(F.col(value) > level), keys, at), keys, gap, least)


def bucketed(intervals: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """A row of each interval for each bucket ``_k`` of ``width`` that it touches."""
    return intervals.withColumn("_k", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def peaks(intervals: DataFrame, curve: DataFrame, keys: list[str], value: str, at: str = "n") -> DataFrame:
    """Intervals with the place and value of the curve's first maximum in each, by a join on buckets of places."""
    spans = bucketed(intervals, F.col("start"), F.col("end"), PLACES)
    inside = spans.join(curve.withColumn("_k", F.floor(F.col(at) / PLACES)), [*keys, "_k"]).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end")))
    best = F.max(F.struct(F.col(value), (-F.col(at)).alias("at")))
    return inside.groupBy(*keys, "interval_id", "start", "end").agg(best.alias("b")).select(*keys, "interval_id", "start", "end", (-F.col("b.at")).alias(f"{at}_peak"), F.col(f"b.{value}").alias("peak"))


def union_on_grid(spans: DataFrame, keys: list[str], dt: float, gap: float) -> DataFrame:
    """(keys, interval_id, t_start, t_end): spans in seconds joined on the grid of step dt; ends grow by half a step."""
    grid = spans.select(*keys, F.floor(F.col("t_start") / dt).cast("long").alias("start"), F.floor(F.col("t_end") / dt).cast("long").alias("end"))
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    touch = grid.withColumn("_new", (before.isNull() | (F.col("start") > before + 1)).cast("int")).withColumn("_id", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    seconds = touch.groupBy(*keys, "_id").agg((F.min("start") * F.lit(dt)).alias("start"), (F.max("end") * F.lit(dt)).alias("end"))
    out = merge(seconds.drop("_id"), keys, gap)
    return out.select(*keys, "interval_id", F.col("start").alias("t_start"), (F.col("end") + dt / 2).alias("t_end"))


def assign(items: DataFrame, intervals: DataFrame, keys: list[str], centre: Column) -> DataFrame:
    """Items with the interval that holds their centre, or else the nearest one; ties go to the first.

    Intervals of a key must not overlap. Then the nearest is the last that
    starts up to the centre or the first after, which two passes over items
    and intervals in order find; an item of a key without intervals is dropped.
    """
    one = F.struct(*(F.col(c) for c in items.columns))
    spans = [c for c in intervals.columns if c not in keys]
    kinds = dict(intervals.dtypes)
    none = F.lit(None).cast("struct<" + ",".join(f"{c}:{kinds[c]}" for c in spans) + ">")
    both = items.select(*keys, centre.alias("_at"), F.lit(1).alias("_item"), one.alias("_one"), none.alias("_span")).unionByName(
        intervals.select(*keys, F.col("t_start").alias("_at"), F.lit(0).alias("_item"), F.struct(*spans).alias("_span")), allowMissingColumns=True
    )
    onward = Window.partitionBy(*keys).orderBy("_at", "_item").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_item")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_a", F.last("_span", True).over(onward)).withColumn("_b", F.last("_span", True).over(back)).where("_item = 1")
    far = lambda x: F.greatest(F.col(f"{x}.t_start") - F.col("_at"), F.col("_at") - F.col(f"{x}.t_end"), F.lit(0.0))
    first = F.col("_b").isNull() | (F.col("_a").isNotNull() & (far("_a") <= far("_b")))
    chosen = near.withColumn("_span", F.when(first, F.col("_a")).otherwise(F.col("_b"))).where(F.col("_span").isNotNull())
    rest = [F.col(f"_one.{c}") for c in items.columns if c not in keys]
    return chosen.select(*keys, *rest, *(F.col(f"_span.{c}") for c in spans))


def overlaps(start: Column, end: Column, low: float, high: float) -> Column:
    return (start <= high) & (end >= low)


def extend(intervals: DataFrame, before: float | None, after: float | None, last: float) -> DataFrame:
    """Intervals grown by so many seconds, or by their own length, and cut at the trace's ends."""
    size = F.col("t_end") - F.col("t_start")
    a, b = (size if v is None else F.lit(float(v)) for v in (before, after))
    return intervals.withColumns({"t_start": F.greatest(F.lit(0.0), F.col("t_start") - a), "t_end": F.least(F.lit(float(last)), F.col("t_end") + b)})


def cut_out(traces: DataFrame, intervals: DataFrame, keys: list[str], dt: float, bucket: int = PLACES) -> DataFrame:
    """(keys, interval_id, n, x): the samples of each interval, by a join on buckets of places."""
    a, b = F.bround(F.col("t_start") / dt).cast("long"), F.bround(F.col("t_end") / dt).cast("long")
    spans = bucketed(intervals.select(*keys, "interval_id", a.alias("_a"), b.alias("_b")), F.col("_a"), F.col("_b"), bucket)
    return traces.withColumn("_k", F.floor(F.col("n") / bucket)).join(spans, [*keys, "_k"]).where((F.col("n") >= F.col("_a")) & (F.col("n") <= F.col("_b"))).select(*keys, "interval_id", "n", "x")


def take(traces: DataFrame, dt: float, low: float | None, high: float | None, at: str = "n") -> DataFrame:
    """Samples (or bins, with the step in hertz) between two limits, rounded half to even."""
    out = traces if low is None else traces.where(F.col(at) >= F.bround(F.lit(low / dt)))
    return out if high is None else out.where(F.col(at) <= F.bround(F.lit(high / dt)))


def segments(intervals: DataFrame, dt: float, gap: float, grow: float | None = None) -> DataFrame:
    """(t_start, t_end) that unite the intervals of all traces, grown by ``grow`` seconds or half their length."""
    # United within spans of time first, so that what meets in one task depends on the time line and not on the traces.
    near = union_on_grid(intervals.withColumn("_all", F.floor(F.col("t_start") / (dt * CHUNK))), ["_all"], dt, gap)
    one = union_on_grid(near.withColumn("_all", F.lit(0)).withColumn("t_end", F.col("t_end") - dt / 2), ["_all"], dt, gap)
    size = (F.col("t_end") - F.col("t_start")) / 2 if grow is None else F.lit(float(grow))
    return one.select((F.col("t_start") - size).alias("t_start"), (F.col("t_end") + size).alias("t_end"))
