"""Connected components: by alternating large and small stars while links are many, and in one task once they are few."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.session import stable

#: Up to so many links (16 bytes each) meet in one task, which spares the shuffles of further rounds; more are dealt out.
FEW = 200_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that links reach from it), by hooking roots to smaller ones and halving paths."""
    node, end = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = end[: len(a)], end[len(a) :]
    root = np.arange(len(node))
    while (root[u] != root[v]).any():
        x, y = root[u], root[v]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    return node, node[root]


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(c).to_numpy() for c in ("a", "b")] for b in batches]
    if parts:
        node, component = least_reached(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    The minimum of a node's neighbours is aggregated before the shuffle and
    joined back, so a star's centre is a skewed join that Spark can split.
    Rounds grow with the logarithm of the longest path; the driver sees two
    numbers a round. What a round leaves is settled in one task if it is no
    more than ``few`` links.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stable(edges), None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after[0] <= few:
            return edges.coalesce(1).mapInArrow(_together, "node long, component long")
        if after == before:
            break
        before = after
        edges = stable(_small(_large(edges)), edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
