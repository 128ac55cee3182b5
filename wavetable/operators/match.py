"""Matching of picks between two sides, and association across stations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from wavetable.operators.intervals import SECONDS, bucketed
from wavetable.session import stable


def near(a: DataFrame, b: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys, i, ta, j, tb, d): all pairs within ``reach``, by a join on buckets of that width."""
    left = a.select(*keys, "i", F.col("t").alias("ta"), F.floor(F.col("t") / reach).alias("_k"))
    right = b.select(*keys, "j", F.col("t").alias("tb"), F.explode(F.sequence(F.floor(F.col("t") / reach) - 1, F.floor(F.col("t") / reach) + 1)).alias("_k"))
    d = F.abs(F.col("ta") - F.col("tb"))
    return left.join(right, [*keys, "_k"]).withColumn("d", d).where(F.col("d") <= reach).drop("_k")


def near_vectors(a: DataFrame, b: DataFrame, keys: list[str], dims: list[str], reach: list[float] | float, order: float = 1.0) -> DataFrame:
    """Pairs of points within a Minkowski distance, or within a limit in each dimension; bucketed along the first one."""
    first = reach if isinstance(reach, float) else reach[0]
    left = a.select(*keys, "i", *(F.col(c).alias(f"_a{c}") for c in dims), F.floor(F.col(dims[0]) / first).alias("_k"))
    right = b.select(*keys, "j", *(F.col(c).alias(f"_b{c}") for c in dims), F.explode(F.sequence(F.floor(F.col(dims[0]) / first) - 1, F.floor(F.col(dims[0]) / first) + 1)).alias("_k"))
    gaps = [F.abs(F.col(f"_a{c}") - F.col(f"_b{c}")) for c in dims]
    total = sum((F.pow(g, F.lit(order)) for g in gaps[1:]), F.pow(gaps[0], F.lit(order)))
    out = left.join(right, [*keys, "_k"]).withColumn("d", F.pow(total, F.lit(1 / order)))
    if isinstance(reach, float):
        return out.where(F.col("d") <= reach).select(*keys, "i", "j", "d")
    for g, r in zip(gaps, reach, strict=True):
        out = out.where(g <= r)
    return out.select(*keys, "i", "j", "d")


def pair(pairs: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Of near pairs those where one side's nearest is taken up from the other side.

    For each i the closest j whose nearest is i, and for each j the closest i
    whose nearest is j; the union may use an element twice. ``strict`` keeps
    mutual nearest ones only, which are one to one. ``paired`` gives the same
    from the sides, without all near pairs.
    """
    of_i, of_j = Window.partitionBy(*keys, "i").orderBy("d", "j"), Window.partitionBy(*keys, "j").orderBy("d", "i")
    ranked = pairs.withColumn("_j", F.row_number().over(of_i) == 1).withColumn("_i", F.row_number().over(of_j) == 1)
    return _taken(ranked, keys, strict).distinct()


def _taken(ranked: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Of pairs with ``_i``, whether i is the nearest of j, and ``_j``, whether j is that of i, those that are taken up."""
    if strict:
        return ranked.where("_i and _j").drop("_i", "_j")
    one, two = Window.partitionBy(*keys, "i").orderBy(F.desc("_i"), "d", "j"), Window.partitionBy(*keys, "j").orderBy(F.desc("_j"), "d", "i")
    first = ranked.withColumn("_one", F.row_number().over(one) == 1).withColumn("_two", F.row_number().over(two) == 1)
    return first.where("(_i and _one) or (_j and _two)").drop("_i", "_j", "_one", "_two")


def _nearest(a: DataFrame, b: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys, i, ta, j, tb, d, _i, _j): the pairs of near ones where i is the nearest of j (``_i``) or j that of i (``_j``).

    Rows at one time have the same distances, so the least id stands for them,
    and no row has more than a neighbour before and one after it in time. Times
    are sorted in buckets wider than ``reach``; the first and the last time of
    a side in a bucket are also put in the bucket before and after it.
    """
    width = 2 * reach

    def times(side: DataFrame, name: str) -> DataFrame:
        known = [F.col(c).isNotNull() for c in (*keys, "t")]
        return side.where(reduce(Column.__and__, known) & ~F.isnan("t")).groupBy(*keys, "t").agg(F.min(name).alias(name)).withColumn("_k", F.floor(F.col("t") / width))

    def rows(side: DataFrame, name: str) -> DataFrame:
        ends = side.groupBy(*keys, "_k").agg(F.min("t").alias("_t0"), F.min_by(name, "t").alias("_x0"), F.max("t").alias("_t1"), F.max_by(name, "t").alias("_x1"))
        sent = F.explode(F.array(*(F.struct((F.col("_k") + step).alias("k"), F.col(f"_t{end}").alias("t"), F.col(f"_x{end}").alias("x")) for end, step in enumerate((-1, 1)))))
        sent = ends.select(*keys, sent.alias("_e")).select(*keys, F.col("_e.k").alias("_k"), "_e.t", F.col("_e.x").alias(name), F.lit(False).alias("_own"))
        return side.withColumn("_own", F.lit(True)).unionByName(sent).withColumn(f"_{name}", F.struct("t", name)).drop(name)

    both = rows(times(a, "i"), "i").unionByName(rows(times(b, "j"), "j"), allowMissingColumns=True).repartition(*keys, "_k")
    bucket, first = Window.partitionBy(*keys, "_k"), F.col("_i").isNotNull()
    before, after = bucket.orderBy("t", F.desc(first)), bucket.orderBy(F.desc("t"), first)
    seen = both.select("*", *(F.last(f"_{x}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{x}{way}") for way, w in enumerate((before, after)) for x in "ij")).where("_own")

    def closest(x: str) -> Column:
        gaps = ((F.abs(F.col("t") - F.col(f"_{x}{way}.t")), F.col(f"_{x}{way}")) for way in range(2))
        return F.least(*(F.when(d <= reach, F.struct(d.alias("d"), at[x].alias(x), at["t"].alias("t"))) for d, at in gaps))

    found = seen.withColumn("_to", F.when(first, closest("j"))).withColumn("_from", F.when(~first, closest("i"))).where("_to is not null or _from is not null")
    either = lambda of_a, of_b: F.when(first, F.col(of_a)).otherwise(F.col(of_b))
    pairs = found.select(*keys, either("_i.i", "_from.i").alias("i"), either("t", "_from.t").alias("ta"), either("_to.j", "_j.j").alias("j"), either("_to.t", "t").alias("tb"), either("_to.d", "_from.d").alias("d"), first.alias("_a"))
    return pairs.groupBy(*keys, "i", "ta", "j", "tb", "d").agg(F.max(~F.col("_a")).alias("_i"), F.max("_a").alias("_j"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], reach: float, strict: bool = False) -> DataFrame:
    """(keys, i, ta, j, tb, d): ``pair`` of the near pairs, of which only nearest ones are made; rows grow with the sides."""
    return _taken(_nearest(a, b, keys, reach), keys, strict)


def match(a: DataFrame, b: DataFrame, keys: list[str], reach: float, strict: bool = False) -> DataFrame:
    """(keys, i, ta, j, tb): pairs, and what stays alone on either side."""
    return _with_alone(a, b, paired(a, b, keys, reach, strict).drop("d"), keys)


def _with_alone(a: DataFrame, b: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    alone_a = a.join(pairs.select(*keys, "i"), [*keys, "i"], "left_anti").select(*keys, "i", F.col("t").alias("ta"))
    alone_b = b.join(pairs.select(*keys, "j"), [*keys, "j"], "left_anti").select(*keys, "j", F.col("t").alias("tb"))
    return pairs.unionByName(alone_a, allowMissingColumns=True).unionByName(alone_b, allowMissingColumns=True)


def align(padded: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``padded`` (keys, i, value) with ``index``: the place j in ``reference`` (keys, j, value) of the value of the same rank, -1 for nulls."""
    left = in_order(padded.where(F.col(value).isNotNull()), keys, "_r", value, "i")
    right = in_order(reference, keys, "_r", value, "j").select(*keys, "_r", F.col("j").alias("index"))
    found = left.join(right, [*keys, "_r"], "left").select(*keys, "i", "index")
    return padded.join(found, [*keys, "i"], "left").withColumn("index", F.coalesce("index", F.lit(-1)))


def in_order(rows: DataFrame, keys: list[str], name: str, by: str, *then: str, width: float = SECONDS) -> DataFrame:
    """``rows`` numbered from 1 in each trace by ``by``, nulls last, and then ``then``.

    Rows are sorted in buckets of ``width``; a bucket begins where the counts
    of those before it end, so no task sorts a trace.
    """
    cut = rows.withColumn("_k", F.when(F.col(by).isNull() | F.isnan(by), F.lit(2**63 - 1)).otherwise(F.floor(F.col(by) / width)).cast("long"))
    ends = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut.groupBy(*keys, "_k").count().select(*keys, "_k", F.coalesce(F.sum("count").over(ends), F.lit(0)).alias("_begin"))
    bucket = Window.partitionBy(*keys, "_k")
    place = F.row_number().over(bucket.orderBy(F.col("_begin").asc_nulls_last(), F.col(by).asc_nulls_last(), *then)) - 1
    return cut.unionByName(begins, allowMissingColumns=True).withColumn(name, (place + F.max("_begin").over(bucket)).cast("long")).where("_begin is null").drop("_k", "_begin")


def numbered(picks: DataFrame, keys: list[str], name: str) -> DataFrame:
    return in_order(picks, keys, name, "t")


def _running(cols: list[str], how: str):
    values = F.array(*cols)
    there = F.filter(values, lambda v: v.isNotNull())
    last = F.element_at(there, -1)
    return {
        "min": F.array_min(values), "max": F.array_max(values), "mean": F.aggregate(there, F.lit(0.0), lambda s, v: s + v) / F.size(there),
        "median": (F.element_at(F.array_sort(there), F.floor((F.size(there) + 1) / 2).cast("int")) + F.element_at(F.array_sort(there), F.ceil((F.size(there) + 1) / 2).cast("int"))) / 2,
        "last": F.col(cols[-1]), "last_not_null": last,
    }.get(how, F.col(how))


def associate(picks: DataFrame, keys: list[str], locations: dict, reach: float, vote_rate: float, how: str = "mean") -> DataFrame:
    """(keys, event, station, t): picks that belong together across stations.

    Stations are taken by their distance from the first one along the line;
    each is matched to the running aggregate of those before, and rows with
    too few picks are dropped. Events are numbered by their earliest pick.
    A step reads the rows before it and its pairs several times, so both are
    checkpointed; a step's plan does not grow with the stations.
    """
    first = min(locations.values())
    order = sorted(locations, key=lambda s: (abs(locations[s] - first), s))
    state, cols = None, []
    for step, s in enumerate(order):
        own = picks.where(F.col("station") == s).select(*keys, "t")
        if state is None:
            state, cols = own.withColumnRenamed("t", "t0"), ["t0"]
            continue
        named = stable(in_order(state.withColumn("t", _running(cols, how)), keys, "i", "t", *cols))
        right, left = numbered(own, keys, "j"), named.where("t is not null").select(*keys, "i", "t")
        pairs = stable(paired(left, right, keys, reach).drop("d"))
        found = _with_alone(left, right, pairs, keys).select(*keys, "i", "j", F.col("tb").alias(f"t{step}"))
        state = named.drop("t").join(found, [*keys, "i"], "full_outer").select(*keys, *cols, f"t{step}")
        cols.append(f"t{step}")
    earliest = F.least(*cols) if len(cols) > 1 else F.col(cols[0])
    votes = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    events = in_order(state.where(votes >= vote_rate * len(order)).withColumn("_t", earliest), keys, "event", "_t", *cols)
    long = F.explode(F.array(*(F.struct(F.lit(s).alias("station"), F.col(c).alias("t")) for s, c in zip(order, cols, strict=True))))
    return events.select(*keys, "event", long.alias("p")).select(*keys, "event", "p.station", "p.t").where("t is not null")


def first_interval(picks: DataFrame, intervals: DataFrame, keys: list[str], width: float = SECONDS) -> DataFrame:
    """Picks with the first interval that holds them, or null, by a join on buckets of ``width`` seconds."""
    spans = bucketed(intervals, F.col("t_start"), F.col("t_end"), width)
    inside = picks.withColumn("_k", F.floor(F.col("t") / width)).join(spans, [*keys, "_k"]).where((F.col("t") >= F.col("t_start")) & (F.col("t") <= F.col("t_end")))
    found = inside.groupBy(*keys, "i").agg(F.min("interval_id").alias("interval_id"))
    return picks.join(found, [*keys, "i"], "left").select(*keys, "i", "t", "interval_id")


def repair(picks: DataFrame, keys: list[str], eps: float = 1.0) -> DataFrame:
    """(keys, i, strong, weak, odd): weak picks off the strong ones' trend, put on the regression line of the others.

    In the order of the strong picks, one is odd if its step from the last
    good pair differs by more than ``eps`` of the strong step; that is a scan
    with state, so a trace's picks pass one task in order, batch by batch.
    """
    import pyarrow as pa

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, good = None, (0.0, 0.0)
        for batch in batches:
            odd = []
            traces = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * len(batch)
            for at, s, w in zip(traces, *(batch.column(c).to_pylist() for c in ("strong", "weak")), strict=True):
                s, w = math.nan if s is None else s, math.nan if w is None else w
                step = s - good[0]
                odd.append(at == last and abs(w - good[1] - step) > eps * abs(step))
                last, good = at, good if odd[-1] else (s, w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.bool_())], names=[*batch.schema.names, "odd"])

    rows = picks.select(*keys, "i", F.col("strong").cast("double").alias("strong"), F.col("weak").cast("double").alias("weak"))
    in_order = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, F.col("strong").asc_nulls_last(), "i")
    scanned = in_order.mapInArrow(scan, StructType([*rows.schema.fields, StructField("odd", BooleanType())]))
    fit = scanned.where("not odd").groupBy(*keys).agg(F.regr_slope("weak", "strong").alias("_s"), F.regr_intercept("weak", "strong").alias("_c"))
    line = F.when(F.col("odd") & F.col("_s").isNotNull(), F.col("_c") + F.col("_s") * F.col("strong")).otherwise(F.col("weak"))
    return (scanned.join(fit, keys, "left") if keys else scanned.crossJoin(fit)).withColumn("weak", line).drop("_s", "_c")
