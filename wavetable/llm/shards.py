"""Training order: every sequence at a slot that a keyed permutation gives it, in shards of fixed stride.

Texts become token ids, cut into sequences of STRIDE tokens; a document's
last one is padded. Sequences are numbered densely by partition offsets, and
a keyed Feistel network with cycle-walking permutes the numbers. Slots are
dense, so ranges of them are known without sampling: each range is one
partition, which writes whole shards. A slot's place is arithmetic, so a
reader can resume anywhere.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm.blocks import groups, mix64, narrow, span_index
from wavetable.llm.bpe import RANKS, encoder
from wavetable.session import stable

#: Tokens of a sequence, sequences of a shard, shards of a range partition, and the id that fills up.
STRIDE, SHARD, RANGE, PAD = 512, 1024, 16, 50256
#: Bytes of an id; the vocabulary has fewer than 65,536.
WIDTH = 2
KEY, ROUNDS = 20_240_229, 6


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of range(n), elementwise: a balanced Feistel network on an even number of bits, walked until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = x.astype(np.uint64, copy=True)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> shift, out[todo] & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ (mix64(a ^ k) & low), a
            else:
                a, b = b, a ^ (mix64(b ^ k) & low)
        out[todo] = a << shift | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _tokenise(batches: Iterable[pa.RecordBatch], ranks: str, stride: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(ranks).whole.encode_ordinary
    part_id, first = TaskContext.get().partitionId(), 0
    for part in groups(batches):
        ids = [array("H", encode(t or "")).tobytes() for t in part.column("text").to_pylist()]
        n = np.array([-(-len(b) // (WIDTH * stride)) for b in ids], np.int64)
        start = first + np.cumsum(n) - n
        first += int(n.sum())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), part_id)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "first", "n", "ids"])


def token_rows(docs: DataFrame, ranks: str = RANKS, stride: int = STRIDE) -> DataFrame:
    """(doc_id, part, first, n, ids) of each row: its ids, and the numbers of its n sequences within its partition."""
    docs = narrow(docs).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(lambda it: _tokenise(it, ranks, stride), "doc_id long, part long, first long, n long, ids binary")


def _place(batches: Iterable[pa.RecordBatch], offsets: dict[int, int], total: int, stride: int, key: int) -> Iterator[pa.RecordBatch]:
    size = WIDTH * stride
    for part in groups(batches, "ids"):
        ids = part.column("ids").to_pylist()
        n = part.column("n").to_numpy()
        if not n.sum():
            continue
        base = np.array([offsets[p] for p in part.column("part").to_pylist()]) + part.column("first").to_numpy()
        slot = permute(span_index(base, n), total, key)
        piece = span_index(np.zeros(len(n), np.int64), n)
        row = np.repeat(np.arange(len(n)), n)
        data = np.full((len(slot), stride), PAD, "<u2")
        at = 0
        for b, k in zip(ids, n.tolist(), strict=True):
            data[at : at + k].reshape(-1)[: len(b) // WIDTH] = np.frombuffer(b, "<u2")
            at += k
        tokens = np.minimum(stride, np.array([len(b) // WIDTH for b in ids])[row] - piece * stride)
        payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(slot), [None, pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(slot), part.column("doc_id").take(pa.array(row)), pa.array(piece), pa.array(tokens), payload], names=["slot", "doc_id", "piece", "n_tokens", "ids"])


def slots(docs: DataFrame, ranks: str = RANKS, stride: int = STRIDE, key: int = KEY) -> tuple[DataFrame, int]:
    """Every sequence as (slot, doc_id, piece, n_tokens, ids) with ids of exactly ``stride`` tokens, and how many there are.

    Token rows are checkpointed, so that texts are encoded once and numbers
    stay as they are when a task runs again. The driver sees one row for each
    partition.
    """
    rows = stable(token_rows(docs, ranks, stride))
    offsets, total = {}, 0
    for part, n in rows.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        offsets[part] = total
        total += n
    placed = rows.mapInArrow(lambda it: _place(it, offsets, total, stride, key), "slot long, doc_id long, piece long, n_tokens long, ids binary")
    return placed, total


def _shards(batches: Iterable[pa.RecordBatch], shard: int, stride: int) -> Iterator[pa.RecordBatch]:
    def rows(held: pa.Table) -> pa.RecordBatch:
        payload = b"".join(held.column("ids").to_pylist())
        slot = held.column("slot")[0].as_py()
        values = [[slot // shard], [slot], [held.num_rows], [stride], [sum(held.column("n_tokens").to_pylist())], [held.column("doc_id").to_pylist()], [hashlib.sha256(payload).hexdigest()], [payload]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["shard", "first_slot", "n_slots", "stride", "n_tokens", "doc_ids", "sha256", "payload"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("slot").to_numpy() // shard
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column("slot")[0].as_py() // shard != int(number[a]):
                yield rows(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield rows(pa.Table.from_batches(held))


def training_shards(docs: DataFrame, ranks: str = RANKS, stride: int = STRIDE, shard: int = SHARD, spread: int = RANGE, key: int = KEY) -> DataFrame:
    """One row for each shard: (shard, first_slot, n_slots, stride, n_tokens, doc_ids, sha256, payload).

    The payload holds the sequences of consecutive slots as little-endian
    unsigned 16-bit ids, ``stride`` each; ``doc_ids`` names their documents in
    slot order and ``n_tokens`` counts ids without padding. Only ``doc_id``
    and ``text`` are read. Null and empty texts have no sequence. Repeated
    rows and repeated or null ids are each encoded. An empty table gives no
    shard.
    """
    placed, total = slots(docs, ranks, stride, key)
    parts = max(1, -(-total // (shard * spread)))
    ranged = placed.repartitionById(parts, (F.col("slot") / (shard * spread)).cast("int")).sortWithinPartitions("slot")
    return ranged.mapInArrow(lambda it: _shards(it, shard, stride), "shard long, first_slot long, n_slots long, stride long, n_tokens long, doc_ids array<long>, sha256 string, payload binary")


def write_shards(shards: DataFrame, path: str) -> None:
    """A Parquet table in shard order; payloads stay as they are, so a slot is at a fixed offset."""
    shards.write.mode("overwrite").option("compression", "none").parquet(path)


def _read(batches: Iterable[pa.RecordBatch], first: int, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            size = WIDTH * r["stride"]
            wanted = range(max(first, r["first_slot"]), min(end, r["first_slot"] + r["n_slots"]))
            at = [(s - r["first_slot"]) for s in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.int64()), pa.array([r["doc_ids"][k] for k in at], pa.int64()), pa.array([r["payload"][k * size : (k + 1) * size] for k in at], pa.binary())], names=["slot", "doc_id", "ids"])


def read_slots(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """The sequences of slots first to end - 1; only the shards that hold them are read."""
    shards = spark.read.parquet(path).where((F.col("first_slot") < end) & (F.col("first_slot") + F.col("n_slots") > first))
    return shards.select("first_slot", "n_slots", "stride", "doc_ids", "payload").mapInArrow(lambda it: _read(it, first, end), "slot long, doc_id long, ids binary")


def op1_training_order(spark, sf_dir: str) -> DataFrame:
    """The query: all documents as shards in training order."""
    return training_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
