"""Connected components of kept cells.

A trace is labelled in tiles of frames. Cells near a tile's end meet those
of the next tile in a join, and only the tiles' labels and their contacts
come together by trace, so a long trace does not meet in one task with all
its cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a tile.
TILE = 4096


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each component."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        open_ = a != b
        if not open_.any():
            break
        pairs, lo, hi = pairs[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(root, hi, lo)
        while (root != root[root]).any():
            root = root[root]
    return root


def neighbours(place: np.ndarray, reach: tuple[int, ...]) -> np.ndarray:
    """Pairs of rows of integer coordinates within ``reach`` in every dimension."""
    size = place.max(axis=0) - place.min(axis=0) + 2 * np.array(reach) + 2
    place = place - place.min(axis=0)
    step = np.concatenate([np.cumprod(size[::-1])[::-1][1:], [1]])
    code = place @ step
    order = np.argsort(code)
    ordered, out = code[order], []
    offsets = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in reach], indexing="ij"), -1).reshape(-1, len(reach))
    for move in offsets[offsets @ step > 0]:
        there = place + move
        ok = (there >= 0).all(axis=1)
        want = code[ok] + int(move @ step)
        at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
        hit = ordered[at] == want
        out.append(np.stack([np.flatnonzero(ok)[hit], order[at[hit]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _octave_label(k: np.ndarray, m: np.ndarray, octaves: float, q_m: int) -> np.ndarray:
    """Labels where the frequency window spans octaves; seeds in raster order, as the window is not symmetric."""
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(k, m, strict=True))}
    label = np.full(len(k), -1)
    for seed in np.lexsort((m, k)):
        if label[seed] >= 0:
            continue
        label[seed], todo = seed, [seed]
        while todo:
            i = todo.pop()
            lo, hi = min(k[i] - 1, round(k[i] * 2**-octaves)), max(k[i] + 1, round(k[i] * 2**octaves))
            for a in range(int(lo), int(hi) + 1):
                for b in range(int(m[i]) - q_m, int(m[i]) + q_m + 1):
                    j = at.get((a, b))
                    if j is not None and label[j] < 0:
                        label[j] = seed
                        todo.append(j)
    return label


def label(cells: DataFrame, keys: list[str], reach: tuple[int, int] = (1, 1), least: tuple[int, int] = (1, 1), along: str | None = None, reach_along: int = 1, votes: int = 1, octaves: float | None = None, tile: int = TILE) -> DataFrame:
    """(keys, [along,] k, m, cluster_id): components of the cells given, which are all kept ones.

    Neighbours are within ``reach`` bins and frames, and within
    ``reach_along`` in the integer column ``along`` if there is one. Clusters
    smaller than ``least`` in either extent, or with fewer than ``votes``
    values of ``along``, are dropped; the others are numbered from 1 by their
    first cell in the order of (along, k, m). ``octaves`` replaces the reach
    in bins by a ratio and the extent in bins by its width in octaves.
    """
    dims = [along] if along else []
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    head = ", ".join(f"{c} {kinds[c]}" for c in keys)
    span = (reach_along, *reach) if along else reach
    cols = [*keys, *dims, "k", "m"]

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf[[*dims, "k", "m"]].to_numpy(np.int64)
        if octaves is not None:
            root = _octave_label(place[:, -2], place[:, -1], octaves, reach[1])
        else:
            root = _roots(neighbours(place, span), len(place))
        return pdf.assign(root=root)

    if octaves is not None:
        tile = 1 << 40
    tiled = cells.select(*cols).withColumn("tile", F.floor(F.col("m") / tile).cast("long"))
    schema = ", ".join([head, *(f"{d} {kinds[d]}" for d in dims), f"k {kinds['k']}, m {kinds['m']}, tile long, root long"])
    found = tiled.groupBy(*keys, "tile").applyInPandas(local, schema.lstrip(", "))
    if octaves is None:
        near = found.where(F.col("m") % tile < reach[1]).select(*keys, *(F.col(c).alias(f"_{c}") for c in (*dims, "k", "m")), (F.col("tile") - 1).alias("tile"), F.col("root").alias("_root"))
        end = found.where(F.col("m") % tile >= tile - reach[1])
        close = F.lit(True)
        for c, r in zip([*dims, "k", "m"], span, strict=True):
            close &= F.abs(F.col(c) - F.col(f"_{c}")) <= r
        touch = end.join(near, [*keys, "tile"]).where(close).select(*keys, "tile", "root", "_root").distinct()

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            names = pd.concat([pdf[["tile", "root"]], pdf[["tile", "_root"]].assign(tile=pdf["tile"] + 1).rename(columns={"_root": "root"})]).drop_duplicates().reset_index(drop=True)
            at = {t: i for i, t in enumerate(names.itertuples(index=False, name=None))}
            pairs = np.array([(at[t, a], at[t + 1, b]) for t, a, b in zip(pdf["tile"], pdf["root"], pdf["_root"], strict=True)]).reshape(-1, 2)
            root = _roots(pairs, len(names))
            first = pdf.iloc[[0] * len(names)][keys].reset_index(drop=True)
            return first.assign(tile=names["tile"], root=names["root"], whole_tile=names["tile"].to_numpy()[root], whole=names["root"].to_numpy()[root])

        joined = touch.groupBy(*keys).applyInPandas(join, f"{head}, tile long, root long, whole_tile long, whole long".lstrip(", "))
        found = found.join(joined, [*keys, "tile", "root"], "left").withColumns({"tile": F.coalesce("whole_tile", "tile"), "root": F.coalesce("whole", "root")}).drop("whole_tile", "whole")
    extent = [F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("m").alias("m0"), F.max("m").alias("m1"), F.min(F.struct(*dims, "k", "m")).alias("first")]
    if along:
        extent.append(F.count_distinct(along).alias("c"))
    sizes = found.groupBy(*keys, "tile", "root").agg(*extent)
    wide = F.log2((F.col("k1") + 1) / (F.col("k0") + F.lit(1e-8))) >= least[0] if octaves is not None else F.col("k1") - F.col("k0") + 1 >= least[0]
    alive = sizes.where(wide & (F.col("m1") - F.col("m0") + 1 >= least[1]))
    alive = alive.where(F.col("c") >= votes) if along else alive
    numbered = alive.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("first")).cast("long") if keys else F.row_number().over(Window.orderBy("first")).cast("long"))
    return found.join(numbered.select(*keys, "tile", "root", "cluster_id"), [*keys, "tile", "root"]).select(*cols, "cluster_id")


def drop_rejected(labels: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of the clusters that are still in the catalog."""
    return labels.join(catalog.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_semi")
