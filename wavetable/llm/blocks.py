"""Arrow helpers shared by the operators: bounded groups of documents and raw text bytes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import threading
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that one vectorised step holds at once; a longer document makes a group of its own.
GROUP_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and a Python worker; texts are long rows.
BATCH_ROWS = "512"


def narrow(docs: DataFrame) -> DataFrame:
    """``docs``, after a session's default batches have been made fit for long rows; a setting of its own stays."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, BATCH_ROWS)
    return docs


#: Seconds between two looks at whether this worker is idle, and the share of them that it works for if not.
LOOK, WORKS = 1.0, 0.05
_tidied = {"process": 0}


def release() -> None:
    """Gives freed memory of this worker back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy() -> None:
    """From now on this worker gives its freed memory back when it falls idle; Spark keeps idle workers for a minute."""
    if _tidied["process"] != os.getpid():
        _tidied["process"] = os.getpid()
        threading.Thread(target=_give_back, daemon=True).start()


def _give_back() -> None:
    worked, before = True, time.process_time()
    while True:
        time.sleep(LOOK)
        busy = time.process_time() - before >= WORKS * LOOK
        if worked and not busy:
            release()
        worked, before = busy, time.process_time()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` text bytes, or one document."""
    tidy()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        at = 0
        while at < n:
            before = end[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(end, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    release()


def gathered(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in blocks of at most ``limit`` text bytes, or one document, across batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in groups(batches, text, limit):
        n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
        if held and size + n > limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n, e = starts[keep], lengths[keep], ends[keep]
    out[0] = s[0]
    out[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one byte string: a count and sizes, then the raw data."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, types: list) -> list[np.ndarray]:
    """The inverse of ``pack`` for the given dtypes."""
    n = len(types)
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at = 8 * (n + 1)
    out = []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
