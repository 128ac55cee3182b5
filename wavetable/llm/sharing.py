"""Which fingerprints occur in more than one block of documents.

A block sends its distinct 32-bit fingerprints, bucket by bucket, as packed
arrays; a bucket's reducer answers each array with one bit for each entry.
A fingerprint costs four bytes on the way, and one that is in every document
is sent once for each block. Buckets without entries send nothing, so rows are
never more than entries, and with blocks of 16 MB an array has hundreds of
entries up to some terabytes of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavetable.llm.blocks import release, tidy

#: Fingerprints that a bucket should hold.
BUCKET = 1 << 20
#: Blocks beside its own in which a fingerprint is hot.
HOT = 128


def buckets_for(fingerprints: float) -> int:
    return max(16, int(fingerprints // BUCKET) + 1)


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each bucket, 32-bit fingerprints) of ascending uint64 keys; buckets are ranges of keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)), _short(keys, buckets)


def _short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits after those that choose the bucket, in key order."""
    bits = max(0, buckets.bit_length() - 1)
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def print_rows(block: int, keys: np.ndarray, buckets: int, note: bytes | None = None) -> pa.RecordBatch:
    """The rows (block, bucket, n, note, prints) that a block sends for its ascending distinct keys; one of them has its note."""
    edge, prints = split(keys, buckets)
    carrier = block % buckets
    at = [i for i in range(buckets) if edge[i] < edge[i + 1] or note is not None and i == carrier]
    cols = [pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([edge[i + 1] - edge[i] for i in at], pa.int32())]
    cols += [pa.array([note if i == carrier else None for i in at], pa.binary()), pa.array([prints[edge[i] : edge[i + 1]].tobytes() for i in at], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["block", "bucket", "n", "note", "prints"])


def _mark(table: pa.Table, many: int) -> pa.Table:
    tidy()
    each = [np.frombuffer(b, "<u4") for b in table.column("prints").to_pylist()]
    every = np.sort(np.concatenate(each))
    twice, count = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
    flags, hot = ([np.packbits(_among(x, values)).tobytes() for x in each] for values in (twice, twice[count >= many]))
    release()
    return table.drop_columns(["prints"]).append_column("flags", pa.array(flags, pa.binary())).append_column("hot", pa.array(hot, pa.binary()))


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x


def mark_shared(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(block, bucket, n, note, flags, hot) of (block, bucket, n, note, prints): n bits, set where another block has the fingerprint, or ``hot`` others.

    Fingerprints should be distinct within a row. ``note`` travels along.
    """
    return prints.groupBy("bucket").applyInArrow(lambda t: _mark(t, hot), "block long, bucket int, n int, note binary, flags binary, hot binary")


def flags_of(rows: list[dict], name: str = "flags") -> np.ndarray:
    """All flags of a block, its rows in bucket order."""
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r[name], np.uint8), count=r["n"]).astype(bool) for r in rows)])
