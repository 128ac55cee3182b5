"""Composite denoisers: traces rebuilt from the cells that stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.functions.constants import divide
from wavetable.operators import label, noise, transform
from wavetable.params import Spectral
from wavetable.plans.detect import detect


def _weighted(cells: DataFrame, weight: Column) -> DataFrame:
    return cells.withColumns({"re": F.col("re") * weight, "im": F.col("im") * weight})


def denoise(traces: DataFrame, keys: list[str], p: Spectral, length: int, component: str | None = None, along: str | None = None) -> DataFrame:
    """(keys, n, x) from labelled and kept cells; the others enter with weight ``background``."""
    parts = detect(traces, keys, p, length, component, along)
    shared = [k for k in keys if k != component]
    cells = parts["cells"].join(parts["labels"], [*shared, "k", "m"], "left")
    weight = F.when(F.col("keep") & F.col("cluster_id").isNotNull(), 1.0).otherwise(float(p.background))
    return transform.istft(_weighted(cells, weight), keys, p.window, p.hop, p.fft, length)


def denoise_power(traces: DataFrame, keys: list[str], p: Spectral, length: int, quiet: Column, level: float) -> DataFrame:
    """(keys, n, x) from the cells whose power deviates from the quiet cells' by ``level``."""
    count = (length - 1) // p.hop + 1
    cells = transform.stft(traces, keys, p.window, p.hop, p.fft)
    scores = noise.power_score(cells, noise.power_model(cells.where(quiet), keys), keys, level, p.band, p.edge, count)
    return transform.istft(_weighted(scores, F.when(F.col("z") > 0, 1.0).otherwise(0.0)), keys, p.window, p.hop, p.fft, length)


def denoise_wavelet(traces: DataFrame, keys: list[str], dt: float, length: int, rho: float, frame: int, voices: int = 4, band: tuple[float, float] | None = None, least: tuple[int, int] = (1, 1), gaps: tuple[int, int] = (1, 1), branch: str | None = None) -> DataFrame:
    """(keys, n, x) from wavelet cells; every scale is a group of its own, with two real components."""
    low, high = band or (None, None)
    cells = transform.cwt(traces, keys, dt, voices, low, high)
    bins = len(transform.wavelet_frequencies(length, dt, voices, low, high))
    blocks = noise.in_blocks(cells, [(i, i) for i in range(bins)], frame, length).withColumn("d", F.lit(2))
    first = divide(length, frame)[0]
    levels = noise.level(blocks, keys, rho, int(0.25 * (first[1] + 1)), branch or ("high" if rho >= 4 else "low"))
    kept = blocks.join(levels.drop("n"), [*keys, "g", "b"]).where(F.col("amp") > F.col("sigma") * F.col("xi"))
    kept = kept.where((F.col("m") >= 2) & (F.col("m") < length - 3))
    labels = label.label(kept.select(*keys, "k", "m"), keys, gaps, least)
    back = transform.icwt(kept.join(labels, [*keys, "k", "m"]), keys, voices)
    return traces.select(*keys, "n").join(back, [*keys, "n"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
