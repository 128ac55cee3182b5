"""Quality scores by a support vector machine on naive-Bayes features.

A document's features are indicators of hashed n-grams: three bytes of the
text, and one to three words by their shape (case, ending, length, and
whether the word repeats the one before). Each indicator is scaled by the
log ratio of its smoothed shares in the two classes. On that a linear
hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import groups, narrow, utf8
from wavetable.llm.host_rules import SPACE, codes, words

BITS = 17
#: Labelled documents to learn from at most, of either class: those with the smallest hashes of their ids.
SAMPLE = 2500
#: Smoothing of the counts, cost of a hinge, passes, relative gain that ends them, and steepness of the score.
ALPHA, COST, PASSES, TOLERANCE, STEEP = 1.0, 1.0, 30, 1e-3, 3.0
#: Rows whose id has this remainder of its CRC-32 by FOLDS are held out.
FOLDS, HELD = 3, 1


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    return ((x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def features(texts: pa.Array) -> list[np.ndarray]:
    """Ascending feature numbers of each text."""
    raw, off = utf8(texts)
    n = len(off) - 1
    tri = np.zeros(len(raw), np.uint64)
    if len(raw) > 2:
        r = raw.astype(np.uint64)
        tri[:-2] = r[:-2] << np.uint64(16) | r[1:-1] << np.uint64(8) | r[2:]
    tri = _hash(tri, 1).astype(np.int32)
    doc, flat = words(texts)
    shape = np.zeros(0, np.int64)
    if len(doc):
        gap = SPACE[raw]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]) | _at(off[:-1], len(raw)) & ~gap)
        last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]]) | _at(off[1:] - 1, len(raw)) & ~gap)
        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        c = codes(flat)
        same = np.concatenate([[False], (c[1:] == c[:-1]) & (doc[1:] == doc[:-1])])
        second = raw[np.minimum(first + 1, last)]
        end = np.where(lower[last] | upper[last] | (raw[last] > 127), 0, raw[last])
        size = np.minimum(last - first, 15)
        shape = upper[first] | (((second >= 65) & (second <= 90)).astype(np.int64) << 1) | same.astype(np.int64) << 2 | size << 3 | end.astype(np.int64) << 8
    w_at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    grams = [_hash(shape, 2)]
    for k in (1, 2):
        longer = shape[: len(shape) - k].copy()
        for j in range(1, k + 1):
            longer = longer * 65_599 + shape[j : len(shape) - k + j]
        grams.append(_hash(longer, 2 + k))
    out, mark = [], np.zeros(1 << BITS, bool)
    for i in range(n):
        mark[tri[off[i] : max(off[i], off[i + 1] - 2)]] = True
        for k, g in enumerate(grams):
            mark[g[w_at[i] : max(w_at[i], w_at[i + 1] - k)]] = True
        found = np.flatnonzero(mark).astype(np.int32)
        mark[found] = False
        out.append(found)
    return out


def _at(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places[(places >= 0) & (places < size)]] = True
    return out


@dataclass(frozen=True)
class Model:
    """Weights by feature number and a bias; a document's margin is the mean over the root of its feature count."""

    weights: np.ndarray
    bias: float

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        margin = np.array([self.weights[f].sum(dtype=np.float64) / max(1, len(f)) ** 0.5 for f in found]) + self.bias
        return 1 / (1 + np.exp(-STEEP * np.clip(margin, -100, 100)))


def fit(found: list[np.ndarray], label: np.ndarray, alpha: float = ALPHA, cost: float = COST, passes: int = PASSES) -> Model:
    """Fits the model; with one class only, or none, the score is 1, 0 or 0.5 throughout, as far as the sigmoid goes."""
    y = np.where(label == 1, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        return Model(np.zeros(1 << BITS, np.float32), float(y[0]) * 10 if len(y) else 0.0)
    p, q = (np.bincount(np.concatenate([f for f, v in zip(found, y, strict=True) if v == s]), minlength=1 << BITS) + alpha for s in (1, -1))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    unit = np.array([max(1, len(f)) ** -0.5 for f in found])
    norm = np.array([(ratio[f] ** 2).sum() for f in found]) * unit**2 + 1
    w, bias, a = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(1)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f = found[i]
            r = ratio[f]
            slope = y[i] * ((w[f] @ r) * unit[i] + bias) - 1
            new = min(cost, max(0.0, a[i] - slope / norm[i]))
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[f] += step * unit[i] * r
                bias += step
                moved, a[i] = moved + abs(step), new
        if moved <= TOLERANCE * (a.sum() + 1e-12):
            break
    return Model((w * ratio).astype(np.float32), float(bias))


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([f.tobytes() for f in features(part.column("text"))], pa.binary())], names=["doc_id", "quality", "found"])


def fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows of either class outside the held-out fold.

    An id with both labels teaches nothing; of rows that share an id one
    counts. The driver gets the sample's features, some kilobytes each.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample).collect() for q in (0, 1)]
    rows = [(int(r["doc_id"]), int(r["quality"])) for part in chosen for r in part]
    if not rows:
        return fit([], np.zeros(0))
    picked = docs.sparkSession.createDataFrame(rows, "doc_id long, quality int")
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(_found, "doc_id long, quality int, found binary")
    there = sorted(found.groupBy("doc_id", "quality").agg(F.min("found").alias("found")).collect(), key=lambda r: r["doc_id"])
    return fit([np.frombuffer(bytes(r["found"]), np.int32) for r in there], np.array([r["quality"] for r in there]))


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        score = model.score(features(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Of ``docs`` only ``doc_id`` and ``text`` are read, of ``labels`` only
    ``doc_id`` and ``quality``. A null text scores like an empty one, which
    has no n-grams: the sigmoid of the bias. Repeated rows and repeated or
    null ids each give their own row; null ids are not held out. Without
    labels of both classes every document gets the same score (see ``fit``).
    """
    docs = narrow(docs).select(F.col("doc_id").cast("long"), "text")
    model = train(docs, labels.select(F.col("doc_id").cast("long"), "quality"), sample)
    out = docs.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        yield part.filter(pa.array(model.score(features(part.column("text"))) >= 0.5))


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``quality_scores`` predicts to be good."""
    model = train(docs.select(F.col("doc_id").cast("long"), "text"), labels.select(F.col("doc_id").cast("long"), "quality"), sample)
    return narrow(docs).mapInArrow(lambda it: _keep(it, model), docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The query: every document's quality score."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
