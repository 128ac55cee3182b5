"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to CHUNK characters are one chunk. Longer ones are cut into chunks
that overlap, which are pre-tokenised in parallel wherever they land. A chunk
may start inside a pre-token, so its first boundaries can be wrong; matching
depends only on what follows a boundary, so from the first boundary that it
shares with its predecessor it is right. The stitch takes the predecessor up
to there and the chunk from there on, and then encodes the pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import groups, narrow
from wavetable.llm.pretokens import Pieces, settled, splitter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 32_768, 512
#: The characters before a chunk's end whose pre-tokens the cut may have changed, beside the last one.
EDGE = 4


class Encoder:
    """The vocabulary of one rank file."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        one = self.whole._core_bpe.encode_single_piece
        self.pieces = Pieces(lambda p: np.array(one(p.encode()), "<u4").tobytes())
        self.split = splitter(public_tokenizers.PATTERN)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not settled(text):
            return np.array(self.whole.encode_ordinary(text), "<u4").tobytes()
        return self.join(self.split(text))

    def join(self, pieces: list[str]) -> bytes:
        cache = self.pieces
        return b"".join([cache[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def boundaries(text: str, start: int, split) -> np.ndarray:
    """Where pre-tokens begin and end, from ``start`` on."""
    sizes = np.fromiter(map(len, split(text)), np.int64)
    return np.concatenate([[start], start + np.cumsum(sizes)])


def stitch(chunks: list[tuple[int, str, np.ndarray]], split) -> Iterator[str]:
    """The pre-tokens of a text from its overlapping chunks (start, text, boundaries), in order.

    Where no boundary of a chunk matches its predecessor's, pre-tokenising
    goes on from the predecessor's last sure boundary, over twice as many
    chunks each time.
    """
    at = 0
    start, text, marks = chunks[0]
    step = 1
    while at + 1 < len(chunks):
        end = start + len(text)
        sure = marks[: max(1, np.searchsorted(marks, min(marks[max(0, len(marks) - 2)], end - EDGE), "right"))]
        next_start, next_text, next_marks = chunks[at + 1]
        common = np.intersect1d(sure, next_marks, assume_unique=True)
        if len(common):
            p = int(common[0])
            yield from _cut(text, start, sure[: np.searchsorted(sure, p) + 1])
            start, text, marks = next_start, next_text, next_marks[np.searchsorted(next_marks, p) :]
            at, step = at + 1, 1
            continue
        q = int(sure[-1])
        yield from _cut(text, start, sure)
        last = min(at + step, len(chunks) - 1)
        tail = [text[q - start :]]
        for k in range(at + 1, last + 1):
            more = chunks[k][1][end - chunks[k][0] :] if end > chunks[k][0] else chunks[k][1]
            tail.append(more)
            end += len(more)
        start, text = q, "".join(tail)
        marks, at, step = boundaries(text, q, split), last, step * 2
    yield from _cut(text, start, marks)


def _cut(text: str, start: int, marks: np.ndarray) -> list[str]:
    m = (marks - start).tolist()
    return [text[a:b] for a, b in zip(m, m[1:], strict=False)]


def chunked(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of the overlapping chunks."""
    return [(i, text[i : i + chunk + overlap]) for i in range(0, max(1, len(text)), chunk)]


def _encode_short(batches: Iterable[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    e = encoder(ranks)
    for part in groups(batches):
        ids = [e.encode(t or "") for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _explode(batches: Iterable[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        rows = [(k, s, t) for k, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True) for s, t in chunked(text, chunk, overlap)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "start", "text"])


def _mark(batches: Iterable[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    split = encoder(ranks).split
    for part in groups(batches):
        marks = [boundaries(t, s, split).tobytes() for s, t in zip(part.column("start").to_pylist(), part.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.binary())], names=["key", "start", "text", "marks"])


def _encode_long(table: pa.Table, ranks: str) -> pa.Table:
    e = encoder(ranks)
    table = table.sort_by("start")
    starts, texts = table.column("start").to_pylist(), table.column("text").to_pylist()
    if all(map(settled, texts)):
        marks = [np.frombuffer(m, np.int64) for m in table.column("marks").to_pylist()]
        ids = e.join(stitch(list(zip(starts, texts, marks, strict=True)), e.split))
    else:
        ids = e.encode("".join(t[: b - a] for a, b, t in zip(starts, [*starts[1:], 1 << 62], texts, strict=True)))
    return pa.table({"key": table.column("key")[:1], "ids": pa.array([ids], pa.binary())})


def encode_texts(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``; ids are little-endian unsigned 32-bit integers.

    Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    A null or empty text has no ids. Repeated rows and repeated or null ids
    each give their own row. Long texts are encoded once for each distinct
    text, found by its SHA-256; only their chunks are shuffled.
    """
    docs = narrow(docs).select(F.col("doc_id").cast("long"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~is_long).mapInArrow(lambda it: _encode_short(it, ranks), "doc_id long, ids binary")
    long = docs.where(is_long).withColumn("key", F.sha2("text", 256))
    chunks = (
        long.select("key", "text")
        .dropDuplicates(["key"])
        .mapInArrow(lambda it: _explode(it, chunk, overlap), "key string, start long, text string")
        .repartition("key", "start")
        .mapInArrow(lambda it: _mark(it, ranks), "key string, start long, text string, marks binary")
    )
    ids = chunks.groupBy("key").applyInArrow(lambda t: _encode_long(t, ranks), "key string, ids binary")
    return short.unionByName(long.select("doc_id", "key").join(ids, "key").select("doc_id", "ids"))


def _decode(batches: Iterable[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    e = encoder(ranks)
    for part in groups(batches, "ids"):
        raw = [None if ids is None else e.decode(ids) for ids in part.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "decoded"])


def decode_ids(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``; null ids stay null. An unknown id is an error."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, ranks), "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Counts and digests of the ids and of the bytes decoded from them."""
    return decode_ids(encode_texts(docs, ranks), ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The query: every document encoded and decoded."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
