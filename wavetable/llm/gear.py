"""Substring deduplication by content-defined chunks.

A gear hash of the last 32 bytes rolls over each text; a chunk ends where the
hash's low bits are zero, within a least and a largest size, so an insertion
moves only the borders near it. Chunks are compared by a 128-bit digest. The
first copy, by document and position, stays; later ones go if they make a run
of at least MIN_RUN bytes or the whole text, as single short chunks recur by
chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import groups, mix64, narrow, utf8
from wavetable.session import stable

#: Bytes of a chunk at least and at most, and low bits of the hash that end one.
LEAST, MOST, MASK = 24, 256, 31
MIN_RUN = 48
#: The order of rows without an id, after all others.
LAST = (1 << 63) - 1
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gears of the last 32 bytes, each shifted by its distance; by doubling."""
    h, size = GEAR[raw], 1
    while size < 32:
        longer = h.copy()
        longer[size:] += h[:-size] << np.uint32(size)
        h, size = longer, size * 2
    return h


def borders(ends: list[int], size: int) -> list[int]:
    """Chunk ends of a text of ``size`` bytes from its ascending candidate ends."""
    out, last = [], 0
    for e in ends:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST:
            out.append(e)
            last = e
    while size - last > MOST:
        last += MOST
        out.append(last)
    if size > last:
        out.append(size)
    return out


def chunks(raw: np.ndarray) -> list[int]:
    """Chunk ends of a text's bytes."""
    return borders((np.flatnonzero((gear_hash(raw) >> np.uint32(16)) & np.uint32(MASK) == 0) + 1).tolist(), len(raw))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, row, d0, d1, start, size, again); ``again`` marks a chunk that its text has had before."""
    digest = xxhash.xxh3_128_digest
    for part in groups(batches):
        raw, off = utf8(part.column("text"))
        rows, starts, sizes, digests, again = [], [], [], [], []
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            text, last, seen = raw[a:b].tobytes(), 0, set()
            ends = chunks(raw[a:b])
            for e in ends:
                d = digest(text[last:e])
                digests.append(d)
                again.append(d in seen)
                seen.add(d)
                starts.append(last)
                sizes.append(e - last)
                last = e
            rows += [k] * len(ends)
        both, at = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), pa.array(rows, pa.int64())
        cols = [part.column("order").take(at), part.column("row").take(at), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(again, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["order", "row", "d0", "d1", "start", "size", "again"])


def runs(starts: np.ndarray, sizes: np.ndarray, least: int = MIN_RUN, whole: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of adjacent chunks with at least ``least`` bytes, or all of ``whole``."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), (starts + sizes)[order].astype(np.int64)
    if not len(s):
        return s, e
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first, last = s[new], e[np.concatenate([new[1:], [True]])]
    keep = (last - first >= least) | (last - first == whole)
    return first[keep], last[keep]


def _cut(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        raw, off = utf8(part.column("text"))
        out = []
        for k, spans in enumerate(part.column("spans").to_pylist()):
            body = raw[off[k] : off[k + 1]]
            pairs = np.array([(x["start"], x["size"]) for x in spans or ()], np.int64).reshape(-1, 2)
            first, last = runs(pairs[:, 0], pairs[:, 1], least, len(body))
            stay = np.ones(len(body), bool)
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                stay[a:b] = False
            kept = body[stay].tobytes()
            out.append((len(body), int((~stay).sum()), len(first), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)], kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def dedupe_chunks(docs: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of each row of ``docs``.

    Only ``doc_id`` and ``text`` are read. ``spans`` are the removed byte
    ranges of the text's UTF-8 and ``kept`` the other bytes. Null and empty
    texts have none. Documents come in the order of their ids; texts that
    share an id are documents of their own, in the order of a hash; equal rows
    with an id are one document, given twice. Rows without an id come last,
    each a document, in the order in which they were first read. The first
    copy of a chunk is the first one in the first document that has it. A
    digest's first document is aggregated before the shuffle; only digests
    that occur again are joined back, where Spark can split a skewed one. A
    row is found again by its id and 64 bits of hash of its text.
    """
    docs = narrow(docs).select(F.col("doc_id").cast("long"), "text")
    # Rows without an id are numbered once and for all.
    loose = stable(docs.where("doc_id is null").withColumn("row", F.monotonically_increasing_id())).withColumn("order", F.lit(LAST))
    docs = docs.where("doc_id is not null").withColumn("row", F.xxhash64("text")).withColumn("order", F.col("doc_id")).unionByName(loose)
    every = docs.where("text is not null").select("order", "row", "text").mapInArrow(_chunks, "order long, row long, d0 long, d1 long, start int, size int, again boolean")
    own = F.struct("order", "row")
    first = every.where("not again").groupBy("d0", "d1").agg(F.min(own).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    found = every.join(first, ["d0", "d1"], "left").where(F.col("again") | (own > F.col("first"))).select("order", "row", "start", "size")
    spans = found.groupBy("order", "row").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return docs.join(spans, ["order", "row"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _cut(it, least), out)


def op3_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: what is removed from every document."""
    return dedupe_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans", "kept")
