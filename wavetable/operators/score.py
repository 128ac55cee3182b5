"""Quality measures of detections and signals, and noisy variants of traces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return (1 + b) * precision * recall / (b * precision + recall + TINY)


def rates(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds precision, recall and f to tp, fp and fn."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + TINY), F.col("tp") / (F.col("tp") + F.col("fn") + TINY)
    return counts.withColumns({"precision": p, "recall": r, "f": f_beta(p, r, beta)})


def flags(rows: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """(keys, tp, fp, fn) of two boolean columns."""
    t, g = F.col(truth), F.col(guess)
    return rows.groupBy(*keys).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))


def cross_entropy(rows: DataFrame, keys: list[str], truth: str, chance: str) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(chance)
    return rows.groupBy(*keys).agg((-F.avg(y * F.ln(p + 1e-32) + (1 - y) * F.ln(1 - p + 1e-32))).alias("cross_entropy"))


def picks(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn) of matched truth (i) and guess (j)."""
    i, j = F.col("i").isNotNull(), F.col("j").isNotNull()
    return matched.groupBy(*keys).agg(F.count_if(i & j).alias("tp"), F.count_if(~i & j).alias("fp"), F.count_if(i & ~j).alias("fn"))


def intervals(placed: DataFrame, guessed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn): true picks in a guessed interval, intervals that are no pick's first one, picks in none."""
    by_pick = placed.groupBy(*keys).agg(F.count("interval_id").alias("tp"), F.count_if(F.col("interval_id").isNull()).alias("fn"))
    empty = guessed.join(placed.where("interval_id is not null").select(*keys, "interval_id").distinct(), [*keys, "interval_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("fp"))
    return by_pick.join(empty, keys, "full_outer").na.fill(0, ["tp", "fp", "fn"])


def lp_error(rows: DataFrame, keys: list[str], truth: str, guess: str, p: float = 2.0, relative: bool = False) -> DataFrame:
    """(keys, error, accuracy): the p-norm of the difference, over that of the truth if relative, and exp(-error)."""
    norm = lambda c: F.pow(F.sum(F.pow(F.abs(c), F.lit(p))), F.lit(1 / p))
    error = norm(F.col(guess) - F.col(truth))
    error = error / norm(F.col(truth)) if relative else error
    return rows.groupBy(*keys).agg(error.alias("error")).withColumn("accuracy", F.exp(-F.col("error")))


def tolerant(rows: DataFrame, keys: list[str], miss: float, slack: int) -> DataFrame:
    """(keys, fn, tp, fp, tn) of runs of samples (n, truth, guess).

    A run of true samples is missed if more than ``miss`` of it is not
    guessed. A run of wrongly guessed samples is false if longer than
    ``slack`` or apart from every guessed true run, and then counts once for
    each ``slack``; otherwise it is a widened detection, and counts as quiet
    only between two of them. Runs of neither count as quiet.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        t, g = pdf["truth"].to_numpy(bool), pdf["guess"].to_numpy(bool)
        kind = np.where(t, 0, np.where(g, 1, 2))
        cut = np.flatnonzero(np.diff(kind)) + 1
        fn = tp = fp = tn = 0
        for a, b in zip([0, *cut], [*cut, len(kind)], strict=True):
            if kind[a] == 0:
                lost = (~g[a:b]).sum() > miss * (b - a)
                fn, tp = fn + lost, tp + (not lost)
            elif kind[a] == 1:
                sides = int(a > 0 and t[a - 1] and g[a - 1]) + int(b < len(kind) and t[b] and g[b])
                wrong = b - a > slack or not sides
                fp, tn = fp + (max((b - a) // slack, 1) if wrong else 0), tn + (not wrong and sides == 2)
            else:
                tn += 1
        return pdf[keys].head(1).assign(fn=int(fn), tp=int(tp), fp=int(fp), tn=int(tn))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(*keys).applyInPandas(count, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "fn long, tp long, fp long, tn long"]))


def parse_metric(name: str) -> tuple[str, dict]:
    """``rel l2`` or ``l1`` for errors, ``picks2.5 f0.5`` for picks, ``f1`` for flags, ``bce`` for cross-entropy."""
    text = name.casefold().strip()
    if m := re.fullmatch(r"(rel\w*\s+)?l(\d+(?:\.\d+)?)", text):
        return "lp", {"relative": bool(m[1]), "p": float(m[2])}
    if m := re.fullmatch(r"picks(\d+(?:\.\d+)?)\s+f(\d+(?:\.\d+)?)", text):
        return "picks", {"reach": float(m[1]), "beta": float(m[2])}
    if m := re.fullmatch(r"f(\d+(?:\.\d+)?)", text):
        return "flags", {"beta": float(m[1])}
    if text in ("bce", "cross entropy", "cross-entropy"):
        return "cross_entropy", {}
    raise ValueError(f"no metric {name!r}")


def measure(name: str, keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The metric of that name as a function of truth and guess.

    Errors take traces (keys, n, x) of both, flags and cross-entropy (keys, n,
    flag) and (keys, n, flag) or (keys, n, chance), picks (keys, t) of both.
    """
    kind, options = parse_metric(name)

    def run(truth: DataFrame, guess: DataFrame) -> DataFrame:
        if kind == "picks":
            from wavetable.operators import match

            found = match.match(match.numbered(truth, keys, "i"), match.numbered(guess, keys, "j"), keys, options["reach"])
            return rates(picks(found, keys), options["beta"])
        both = {"lp": ("x", "x"), "flags": ("flag", "flag"), "cross_entropy": ("flag", "chance")}[kind]
        rows = truth.select(*keys, "n", F.col(both[0]).alias("_truth")).join(guess.select(*keys, "n", F.col(both[1]).alias("_guess")), [*keys, "n"])
        if kind == "lp":
            return lp_error(rows, keys, "_truth", "_guess", **options)
        return rates(flags(rows, keys, "_truth", "_guess"), options["beta"]) if kind == "flags" else cross_entropy(rows, keys, "_truth", "_guess")

    return run


def evaluate(cases: Iterable, operator: Callable, metrics: dict[str, Callable], prepare: Callable | None = None) -> list[dict]:
    """Applies the operator to each (input, truth, attributes) and lists its measures; inputs and results are DataFrames."""
    out = []
    for x, y, attributes in cases:
        result = (prepare(operator, attributes) if prepare else operator)(x)
        out.append(dict(attributes) | {name: metric(y, result) for name, metric in metrics.items()})
    return out


def augment(traces: DataFrame, keys: list[str], levels: list[float], colours: list[float] = (0.0,), repeats: int = 1, dropout: float = 0.0, seed: int = 1) -> DataFrame:
    """Every trace with noise of every level, colour and repeat; colour is the exponent of its falling power spectrum.

    Noise depends on the seed, the trace's keys and the variant alone. A task
    holds one variant of one trace.
    """
    spark = traces.sparkSession
    grid = spark.createDataFrame([(float(a), float(c), r) for a in levels for c in colours for r in range(repeats)], "level double, colour double, repeat int")
    kinds = {f.name: f.dataType.simpleString() for f in traces.schema.fields}
    by = [*keys, "level", "colour", "repeat"]

    def noisy(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("n").reset_index(drop=True)
        head = pdf.iloc[0]
        rng = np.random.default_rng([seed, zlib.crc32(repr([str(head[c]) for c in by]).encode())])
        noise = rng.standard_normal(len(pdf))
        if head["colour"]:
            f = np.fft.rfftfreq(len(pdf))
            f[0] = f[1] if len(f) > 1 else 1
            noise = np.fft.irfft(np.fft.rfft(noise) * f ** (-head["colour"] / 2), len(pdf))
            noise /= noise.std() or 1
        keep = rng.random() >= dropout
        return pdf.assign(x=keep * (pdf["x"] + head["level"] * noise))

    wide = traces.select(*keys, "n", "x").join(F.broadcast(grid))
    return wide.groupBy(*by).applyInPandas(noisy, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, x double, level double, colour double, repeat int"])).select(*by, "n", "x")


def scaled_grid(traces: DataFrame, reference: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """Every trace plus a reference noise (n, x) of unit deviation at every level."""
    grid = traces.sparkSession.createDataFrame([(float(a),) for a in levels], "level double")
    deviation = reference.agg(F.stddev_pop("x").alias("_d"))
    noise = reference.join(F.broadcast(deviation)).select("n", (F.col("x") / F.col("_d")).alias("_x"))
    return traces.join(noise, "n").join(F.broadcast(grid)).select(*keys, "level", "n", (F.col("x") + F.col("_x") * F.col("level")).alias("x"))
