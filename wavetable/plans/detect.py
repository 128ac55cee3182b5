"""Composite detectors: from traces to clusters, catalogs, curves and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.functions.constants import bin_groups
from wavetable.operators import features, intervals, label, noise, transform
from wavetable.params import Spectral
from wavetable.session import stable
from wavetable.sources import files


def cells_of(traces: DataFrame, keys: list[str], p: Spectral, length: int) -> DataFrame:
    """Cells with amplitude, ratio to the noise, and whether they stand out."""
    count = (length - 1) // p.hop + 1
    width = max(1, round(p.group_hz / p.df)) if p.group_hz else 1
    cells = transform.stft(traces, keys, p.window, p.hop, p.fft)
    cells = noise.snr(cells, keys, bin_groups(p.bins, width), p.frame, count, p.rho, p.least_fraction, big_rho=p.big_rho)
    return noise.trim(cells, count, p.edge, p.band)


def detect(traces: DataFrame, keys: list[str], p: Spectral, length: int, component: str | None = None, along: str | None = None, keep: Callable[[DataFrame], Column] | None = None) -> dict[str, DataFrame]:
    """Relations by name: cells, labels, catalog, likelihood, intervals, picks.

    The kept cells, a small part of all, are checkpointed, since labels and
    features both read them; the rest is lazy.

    ``component`` names a key over which masks unite before clustering;
    ``along`` an integer key along which clusters extend; ``keep`` a
    predicate on the catalog.
    """
    cells = cells_of(traces, keys, p, length)
    outer = [k for k in keys if k not in (component, along)]
    shared = [k for k in keys if k != component]
    kept = stable(cells.where("keep"))
    mask = noise.over_components(kept, [*shared, "k", "m"], "keep") if component else kept.select(*shared, "k", "m")
    labels = label.label(mask, outer, p.gaps, p.sizes, along, 1, p.min_traces)
    step = p.hop * p.dt
    labelled = kept.join(labels, [*shared, "k", "m"])
    merged = labelled
    if component:
        merged = labelled.groupBy(*shared, "cluster_id", "k", "m").agg(F.sqrt(F.sum(F.col("amp") ** 2)).alias("amp"), F.sqrt(F.sum(F.col("snr") ** 2)).alias("snr"))
    catalog = features.catalog(merged, shared, features.extent(step, p.df))
    if keep is not None:
        catalog = catalog.where(keep(catalog))
        labelled = label.drop_rejected(labelled, catalog, shared)
    curve = features.likelihood(labelled, keys)
    spans = catalog.select(*shared, "cluster_id", F.col("time_start").alias("t_start"), F.col("time_end").alias("t_end"), "time_peak", "energy_peak", "frequency_peak")
    found = intervals.union_on_grid(spans, shared, step, p.gaps[1] * step)
    placed = intervals.assign(spans.withColumnsRenamed({"t_start": "a", "t_end": "z"}), found, shared, (F.col("a") + F.col("z")) / 2)
    top = features.best(placed, [*shared, "interval_id"], "energy_peak", ["cluster_id"]).select(*shared, "interval_id", "time_peak", "energy_peak", "frequency_peak")
    return {"cells": cells, "labels": labels, "catalog": catalog, "likelihood": curve, "intervals": found, "picks": top}


def detect_on_files(spark: SparkSession, path: str, keys: list[str], p: Spectral, length: int, out: str, names: tuple[str, ...] = ("catalog", "intervals", "picks"), component: str | None = None, kind: str | None = None, chunk: int | None = None) -> Spectral:
    """Runs ``detect`` on every file of traces (keys, n, x and, if there, delta) under ``path`` and writes the relations to ``out``.

    A file is a key of its own (``source_file``), by which results are
    partitioned, so all files are one job and each keeps its results apart.
    ``chunk`` cuts traces into pieces of so many samples, keys too
    (``chunk_id``). Where the files' sampling step is not ``p.dt``, the
    parameters are taken over to it; files of several steps are an error. A
    later run replaces only the files that it reads. Returns the parameters
    used, which are saved too.
    """
    rows = files.read_any(spark, path, kind)
    if "delta" in rows.columns:
        step = files.one_step(rows)
        p = p if step == p.dt else p.with_step(step)
    by = ["source_file", *keys]
    if chunk is not None:
        rows = files.chunked(rows, chunk).withColumn("n", F.col("n") % chunk)
        by, length = [*by, "chunk_id"], chunk
    found = detect(rows.select(*by, "n", "x"), by, p, length, component)
    for name in names:
        found[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(f"{out}/{name}")
    files.save({}, out, p.as_dict(), spark=spark)
    return p


def detect_sta_lta(traces: DataFrame, keys: list[str], long: int, short: int, level: float, gap: int, least: int = 0, over: list[str] | None = None, how: str = "max") -> dict[str, DataFrame]:
    """Curve, intervals and peaks of the moving-average detector; ``over`` keeps these keys and aggregates the rest."""
    curve = intervals.sta_lta(traces, keys, long, short)
    if over is not None:
        keys, curve = over, noise.over_components(curve, [*over, "n"], "ratio", how)
    found = intervals.from_curve(curve, keys, "ratio", level, gap, least)
    return {"curve": curve, "intervals": found, "peaks": intervals.peaks(found, curve, keys, "ratio")}


def detect_power(traces: DataFrame, keys: list[str], p: Spectral, length: int, quiet: Column, level: float, gap: int) -> dict[str, DataFrame]:
    """Model, scores, curve, intervals and peaks of the detector that knows the quiet cells' power."""
    count = (length - 1) // p.hop + 1
    cells = transform.stft(traces, keys, p.window, p.hop, p.fft)
    model = noise.power_model(cells.where(quiet), keys)
    scores = noise.power_score(cells, model, keys, 1.0, p.band, p.edge, count)
    curve = scores.groupBy(*keys, "m").agg((F.sum("z") / F.lit(p.bins)).alias("likelihood"))
    found = intervals.from_curve(curve, keys, "likelihood", level, gap, at="m")
    return {"model": model, "scores": scores, "curve": curve, "intervals": found, "peaks": intervals.peaks(found, curve, keys, "likelihood", "m")}


def detect_with_model(traces: DataFrame, keys: list[str], model: Callable, level: float, gap: int) -> dict[str, DataFrame]:
    """Intervals from a model of one's own: a ``mapInPandas`` function that turns (keys, n, x) into (keys, n, likelihood)."""
    kinds = {f.name: f.dataType.simpleString() for f in traces.schema.fields}
    curve = traces.mapInPandas(model, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, likelihood double"]))
    found = intervals.from_curve(curve, keys, "likelihood", level, gap)
    return {"curve": curve, "intervals": found, "peaks": intervals.peaks(found, curve, keys, "likelihood")}


def pick_phases(traces: DataFrame, keys: list[str], height: float, prominence: float | None = None) -> DataFrame:
    """(keys, n, x, prominence, width): peaks of each trace's envelope, for a picker that repairs them with ``match.repair``."""
    from wavetable.operators import phases

    return phases.peaks(transform.envelope(traces, keys), keys, "x", height=height, prominence=prominence)
