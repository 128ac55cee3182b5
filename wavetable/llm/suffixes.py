"""Suffix-array deduplication: bytes of 50-byte strings that a smaller document has too are removed.

Equal 50-byte windows choose the same 32-byte anchor inside themselves (a
modular minimiser: the place of the least 13-byte hash in the window, modulo
the number of anchor places), so all copies of a window meet at its anchor.
1. Blocks of documents tell which anchors other blocks have too (sharing.py).
2. Around shared anchors they send the bytes of the windows, equal segments
   once a block, to the bucket of the anchor. Of an anchor that many blocks
   have each window is a segment of its own and goes to the bucket of its
   bytes, so that no key gathers an unbounded group.
3. A bucket sorts the suffixes of its segments at the window starts. In
   suffix order the previous and next entries of a smaller document give the
   longest previous factor; windows where it reaches 50 are marked.
4. Marks meet their blocks again and the bytes are cut.
A text that equals a whole text of a smaller document is marked by its digest
and takes no part in 2 and 3, as all its windows are in that document too.

A block is as large as a worker's memory allows, since blocks and buckets both
grow with the input: what one sends to another is a row with many entries
until there are more pairs of them than entries, and an entry a row beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import gathered, mix64, narrow, pack, release, span_index, tidy, unpack, utf8
from wavetable.llm.sharing import HOT, buckets_for, flags_of, mark_shared, print_rows
from wavetable.session import stable

#: Bytes of a string, of an anchor in it, and of the hashed strings that choose the anchor.
LENGTH, ANCHOR, GRAM = 50, 32, 13
PLACES = LENGTH - ANCHOR + 1
#: Low bits of a gram's hash that hold its place; longer bytes are taken in parts.
PLACE_BITS = 24
BLOCK_BYTES = 16 << 20
#: Bytes whose anchors are looked for at once.
PIECE_BYTES = 1 << 18
#: Text bytes for each bucket of segments, buckets at least, and the parts that a bucket is sorted in.
SORTED, LEAST_BUCKETS, PARTS = 16 << 20, 64, 16
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(raw: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(LENGTH + 14, np.uint8)])
    return np.ndarray((len(raw) + LENGTH + 7,), f"{order}u8", padded, strides=(1,))


def _places(w: np.ndarray, n: int, starts: np.ndarray, bits: int) -> np.ndarray:
    """Each window's anchor place in ``n`` bytes, 2**bits at most, whose words are ``w``."""
    low = np.uint64((1 << bits) - 1)
    h = mix64(w[:n] * np.uint64(0x9E3779B97F4A7C15) + w[GRAM - 8 : n + GRAM - 8])
    h = (h & ~low) | np.arange(n, dtype=np.uint64)
    size, many = 1, LENGTH - GRAM + 1
    while size * 2 <= many:
        longer = h.copy()
        np.minimum(h[:-size], h[size:], out=longer[:-size])
        h, size = longer, size * 2
    least = np.minimum(h[starts], h[starts + (many - size)])
    return starts + ((least & low).astype(np.int64) - starts) % PLACES


def anchors(raw: np.ndarray, off: np.ndarray, bits: int = PLACE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each window's anchor place, key of the anchor at each byte it starts at or 0).

    Parts of 2**bits bytes overlap by a window less a byte, so each window
    lies in one as a whole; its anchor depends on its own bytes alone.
    """
    n = len(raw)
    key = np.zeros(n, np.uint64)
    starts = span_index(off[:-1], np.maximum(0, np.diff(off) - LENGTH + 1))
    if not len(starts):
        return starts, starts, key
    w = _words(raw)
    place, step = np.empty(len(starts), np.int64), (1 << bits) - LENGTH + 1
    for at in range(0, n, step):
        i, j = np.searchsorted(starts, [at, at + step])
        if i < j:
            place[i:j] = at + _places(w[at:], min(n - at, 1 << bits), starts[i:j] - at, bits)
    used = np.zeros(n, bool)
    used[place] = True
    at = np.flatnonzero(used)
    k = np.zeros(len(at), np.uint64)
    for j in range(0, ANCHOR, 8):
        k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + w[at + j])
    key[at] = np.maximum(k, np.uint64(1))
    return starts, place, key


def _blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=1)
    for part in gathered(batches, limit):
        raw, off = utf8(part.column("text"))
        body = raw.tobytes()
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]), np.int64)
        ids = part.column("doc_id")
        note = pack([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False), off, digest])
        rest = part.select([n for n in part.schema.names if n != "text"])
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_batch(rest)
            extra = sink.getvalue().to_pybytes()
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(body)]), *(pa.array([x], pa.binary()) for x in (note, press.compress(body), press.compress(extra)))], names=["block", "size", "note", "body", "extra"])
        block += 1


class Block:
    """A block's documents: ids, which ids there are, offsets, digests and bytes."""

    def __init__(self, note: bytes, body: bytes):
        tidy()
        self.ids, self.valid, self.off, digest = unpack(note, [np.int64, bool, np.int64, np.int64])
        self.digest = digest.reshape(-1, 2)
        size = int(self.off[-1])
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=size), np.uint8) if size else np.zeros(0, np.uint8)

    def only(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the chosen documents."""
        size = np.diff(self.off)[chosen]
        return self.raw[span_index(self.off[chosen], size)], np.concatenate([[0], np.cumsum(size)])

    def pieces(self, chosen: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The chosen documents by runs of at most PIECE_BYTES, or one: (number of the first, bytes before it, bytes, offsets)."""
        end = np.cumsum(np.diff(self.off)[chosen])
        at = 0
        while at < len(chosen):
            before = int(end[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(end, before + PIECE_BYTES, "right")))
            yield at, before, *self.only(chosen[at:stop])
            at = stop

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The ascending anchor keys of the block's distinct texts, and which of them two of these texts have."""
        where = np.flatnonzero(self.valid & (np.diff(self.off) >= LENGTH))
        _, first = np.unique(self.digest[where], axis=0, return_index=True) if len(where) else (None, where)
        found = []
        for number, _, raw, off in self.pieces(where[np.sort(first)]):
            key = anchors(raw, off)[2]
            at = np.flatnonzero(key)
            found.append((key[at], number + np.searchsorted(off, at, "right")))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        doc = doc[order]
        return keys, np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)


def _prints(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            keys, _ = Block(r["note"], r["body"]).keys()
            yield print_rows(r["block"], keys, buckets)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, valid, off, digest = unpack(r["note"], [np.int64, bool, np.int64, np.int64])
            at = np.flatnonzero(valid & (np.diff(off) >= LENGTH))
            d = digest.reshape(-1, 2)[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["block"])), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["block", "local", "doc_id", "d0", "d1"])


def _runs(starts: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of the maximal runs of consecutive starts with one label."""
    if not len(starts):
        return starts, starts
    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(label) != 0)])
    return np.flatnonzero(new), np.flatnonzero(np.concatenate([new[1:], [True]]))


def _firsts(digest: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal digest: the index of one with the least order, and that order, at each row."""
    rank = np.lexsort((order, digest[:, 1], digest[:, 0]))
    d = digest[rank]
    new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])
    head = rank[new][np.cumsum(new) - 1]
    out = np.empty(len(rank), np.int64)
    out[rank] = head
    return out, order[out]


def _window_digests(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of hash of the windows at the places ``at``."""
    w, k = _words(raw), np.ones(len(at), np.uint64)
    for j in (0, 8, 16, 24, 32, 40, 42):
        k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + w[at + j])
    return k


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the union of the ranges, ascending; ranges that touch become one."""
    order = np.lexsort((start, doc))
    base = doc[order].astype(np.int64) << 33
    s, e = base + start[order], np.maximum.accumulate(base + end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])[: len(s)]
    first, last = np.flatnonzero(new), np.flatnonzero(np.concatenate([new[1:], [True]])[: len(s)])
    return s[first] >> 33, s[first] & 0x1FFFFFFFF, e[last] & 0x1FFFFFFFF


def _segments(b: Block, where: np.ndarray, keys: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
    """[start, end, route, digest] of the segments around shared anchors in the bytes of the chosen documents."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))]
    for _, before, part, off in b.pieces(where):
        s, p, key = anchors(part, off)
        k = np.searchsorted(keys, key[p])
        cold, each = shared[k] & ~hot[k], np.flatnonzero(shared[k] & hot[k])
        first, last = _runs(s[cold], p[cold])
        a = np.concatenate([s[cold][first], s[each]])
        z = np.concatenate([s[cold][last], s[each]]) + LENGTH
        route = np.concatenate([key[p[cold][first]], _window_digests(part, s[each])])
        body = part.tobytes()
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)]), np.uint64)
        found.append((a + before, z + before, route, digest.reshape(-1, 2)))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _around(block_table: pa.Table, info: pa.Table, buckets: int) -> pa.Table:
    """Rows (bucket, kind, block, blob): segments (0), and the marks that the block itself can tell (1)."""
    names = {"bucket": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "blob": pa.binary()}
    if not block_table.num_rows:
        return pa.table({k: pa.array([], t) for k, t in names.items()})
    r = block_table.to_pylist()[0]
    b, rows = Block(r["note"], r["body"]), info.sort_by("bucket").to_pylist()
    copies = [x["n"] for x in rows if x["bucket"] < 0]
    rows = [x for x in rows if x["bucket"] >= 0]
    keys, local = b.keys()
    shared, hot = local | flags_of(rows), flags_of(rows, "hot")
    chosen = b.valid & (np.diff(b.off) >= LENGTH)
    chosen[copies] = False
    where = np.flatnonzero(chosen)
    raw, off = b.only(where)
    start, end, route, digest = _segments(b, where, keys, shared, hot)
    doc = np.searchsorted(off, start, "right") - 1
    ids = b.ids[where[doc]]
    head, least = _firsts(digest, ids) if len(ids) else (None, ids)
    later = ids > least
    whole = np.array(copies, np.int64)
    marks = _merged(np.concatenate([where[doc[later]], whole]), np.concatenate([(start - off[doc])[later], np.zeros(len(whole), np.int64)]), np.concatenate([(end - off[doc])[later], np.diff(b.off)[whole]]))
    press = zstandard.ZstdCompressor(level=1)
    out = [(r["block"] % buckets, 1, press.compress(pack([m.astype(np.int32) for m in marks])))]
    keep = np.flatnonzero(~later)
    part = ((route[keep] >> np.uint64(32)) * np.uint64(buckets * PARTS) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keep, part = keep[order], part[order]
    edge = np.searchsorted(part, np.arange(buckets + 1) * PARTS)
    for i in range(buckets):
        x = keep[edge[i] : edge[i + 1]]
        if len(x):
            size = end[x] - start[x]
            arrays = [ids[x], where[doc[x]].astype(np.int32), (start - off[doc])[x].astype(np.int32), size.astype(np.int32), (part[edge[i] : edge[i + 1]] % PARTS).astype(np.uint8), raw[span_index(start[x], size)]]
            out.append((i, 0, press.compress(pack(arrays))))
    bucket, kind, blob = zip(*out, strict=True)
    release()
    return pa.table([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array([r["block"]] * len(out), pa.int64()), pa.array(blob, pa.binary())], names=list(names))


def suffix_order(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` in the order of their first LENGTH bytes, and the bytes each shares with the one before, LENGTH at most."""
    w = _words(raw, ">")
    columns = [w[at + j].astype(np.uint64) for j in range(0, LENGTH - 8, 8)] + [w[at + LENGTH - 8].astype(np.uint64)]
    steps = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    rank = np.lexsort(columns[::-1])
    lcp, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j, c in zip(steps, columns, strict=True):
        c = c[rank]
        differ = np.concatenate([NONE[None], c[1:] ^ c[:-1]]) if len(c) else c
        differ = differ.astype(np.uint64)
        zeros = 8 * np.ones(len(at), np.int64)
        some = differ != 0
        # The highest set byte of the difference; exact, as it is isolated by shifts.
        left = np.zeros(len(at), np.int64)
        rest = differ.copy()
        for s in (32, 16, 8):
            up = rest >> np.uint64(64 - s) == 0
            up &= some
            left[up] += s // 8
            rest[up] <<= np.uint64(s)
        zeros[some] = left[some]
        lcp = np.where(open_, np.minimum(LENGTH, j + zeros), lcp)
        open_ &= ~some
    if len(lcp):
        lcp[0] = 0
    return rank, lcp


def smaller_before(value: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The nearest earlier index of the same run with a smaller value, or -1; pointers jump until they hold."""
    p = np.arange(-1, len(value) - 1)
    todo = np.arange(len(value))
    while len(todo):
        out = (p[todo] >= 0) & (run[np.maximum(p[todo], 0)] != run[todo])
        p[todo[out]] = -1
        todo = todo[p[todo] >= 0]
        todo = todo[value[p[todo]] >= value[todo]]
        p[todo] = p[p[todo]]
    return p


def previous_factors(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Where, in suffix order, the longest factor that a smaller document has too reaches LENGTH.

    Only entries linked by common prefixes of LENGTH bytes can give it, so
    the smaller neighbours are looked for within such runs.
    """
    run = np.cumsum(lcp < LENGTH)
    back = smaller_before(doc[::-1], run[::-1])
    return (smaller_before(doc, run) >= 0) | (back[::-1] >= 0)


def _again(doc: np.ndarray, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, end) of what segments of a smaller document have too, where they meet by a common anchor."""
    at = np.cumsum(size) - size
    body = raw.tobytes()
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[i : i + n]) for i, n in zip(at.tolist(), size.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    head, least = _firsts(digest, doc)
    later = np.flatnonzero(doc > least)
    # One segment of each kind is sorted; others of the same document share what is found.
    own = np.unique(head)
    many = size[own] - LENGTH + 1
    place, of = span_index(at[own], many), np.repeat(own, many)
    rank, lcp = suffix_order(raw, place)
    hit = np.zeros(len(place), bool)
    hit[rank] = previous_factors(doc[of][rank], lcp)
    p, o = place[hit], of[hit]
    f, g = _runs(p, o)
    first, last, o = p[f] - at[o[f]], p[g] - at[o[f]] + LENGTH, o[f]
    same = np.flatnonzero(doc == least)
    order = np.argsort(o, kind="stable")
    lo, hi = np.searchsorted(o[order], head[same]), np.searchsorted(o[order], head[same], "right")
    use = order[span_index(lo, hi - lo)]
    return np.concatenate([later, np.repeat(same, hi - lo)]), np.concatenate([np.zeros(len(later), np.int64), first[use]]), np.concatenate([size[later], last[use]])


def _judge(table: pa.Table) -> pa.Table:
    """Rows (block, blob) with marks (local, start, end) from a bucket's segments and settled marks."""
    tidy()
    unzip = zstandard.ZstdDecompressor()
    out: list[tuple[int, bytes]] = []
    seg = []
    for name, kind, blob in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "blob")), strict=True):
        if kind:
            out.append((name, unzip.decompress(blob)))
        else:
            seg.append((name, *unpack(unzip.decompress(blob), [np.int64, np.int32, np.int32, np.int32, np.uint8, np.uint8])))
    del table
    if seg:
        names = np.array([x[0] for x in seg])
        block = np.repeat(np.arange(len(seg)), [len(x[1]) for x in seg])
        doc, local, start, size, part, raw = (np.concatenate([x[k] for x in seg]) for k in range(1, 7))
        seg.clear()
        size, at = size.astype(np.int64), np.cumsum(size, dtype=np.int64) - size
        found = [(np.zeros(0, np.int64),) * 3]
        for k in range(PARTS):
            x = np.flatnonzero(part == k)
            if len(x):
                i, s, e = _again(doc[x], size[x], raw[span_index(at[x], size[x])])
                found.append((x[i], s + start[x[i]], e + start[x[i]]))
        i, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(block[i], kind="stable")
        i, s, e = i[order], s[order], e[order]
        edge = np.searchsorted(block[i], np.arange(len(names) + 1))
        for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if lo < hi:
                marks = _merged(local[i[lo:hi]], s[lo:hi], e[lo:hi])
                out.append((int(names[k]), pack([m.astype(np.int32) for m in marks])))
    release()
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})


def _gone(b: Block, marks: pa.Table) -> np.ndarray:
    """Which bytes of a block are marked."""
    change = np.zeros(len(b.raw) + 1, np.int8)
    each = [unpack(blob, [np.int32, np.int32, np.int32]) for blob in marks.column("blob").to_pylist()]
    if each:
        i, s, e = _merged(*(np.concatenate([x[k] for x in each]) for k in range(3)))
        np.add.at(change, b.off[i] + s, 1)
        np.add.at(change, b.off[i] + e, -1)
    return np.cumsum(change, dtype=np.int8)[:-1] > 0


def _report(block_table: pa.Table, marks: pa.Table, texts: bool) -> pa.Table:
    rows = []
    ids = pa.array([], pa.int64())
    if block_table.num_rows:
        r = block_table.to_pylist()[0]
        b = Block(r["note"], r["body"])
        ids, gone = pa.array(b.ids, mask=~b.valid), _gone(b, marks)
        for a, z in zip(b.off[:-1].tolist(), b.off[1:].tolist(), strict=True):
            g = gone[a:z]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            kept = b.raw[a:z][~g].tobytes() if len(edge) else b.raw[a:z].tobytes()
            spans = [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            rows.append((z - a, int(g.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, *([kept] if texts else [])))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), *([pa.binary()] if texts else [])]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    return pa.table([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names[: len(kinds) + 1])


def _replace(block_table: pa.Table, marks: pa.Table, names: list[str]) -> pa.Table:
    if not block_table.num_rows:
        return pa.table({})
    r = block_table.to_pylist()[0]
    b = Block(r["note"], r["body"])
    stay = ~_gone(b, marks)
    rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(r["extra"])).read_all()
    kept = [b.raw[a:z][stay[a:z]].tobytes().decode("utf-8", "ignore") for a, z in zip(b.off[:-1].tolist(), b.off[1:].tolist(), strict=True)]
    return pa.table([pa.array(kept, pa.string()) if n == "text" else rest.column(n) for n in names], names=names)


def marked(docs: DataFrame, block_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The checkpointed blocks of ``docs`` with all its columns, and the marks of bytes to remove from them.

    Blocks meet segments and marks by the same exchange, which Spark makes once.
    """
    blocks = stable(narrow(docs).mapInArrow(lambda it: _blocks(it, block_bytes), "block long, size long, note binary, body binary, extra binary"))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = buckets_for(size * 3 / (LENGTH - GRAM + 2))
    flags = mark_shared(blocks.mapInArrow(lambda it: _prints(it, buckets), "block long, bucket int, n int, note binary, prints binary"), hot)
    # The aggregate is cut off from the join, so that a digest of very many texts is a skewed join that Spark can split.
    texts = blocks.mapInArrow(_digests, "block long, local int, doc_id long, d0 long, d1 long")
    least = stable(texts.groupBy("d0", "d1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    copies = texts.join(least, ["d0", "d1"]).where("doc_id > least").select("block", F.lit(-1).alias("bucket"), F.col("local").alias("n"), F.lit(None).cast("binary").alias("flags"), F.lit(None).cast("binary").alias("hot"))
    info = flags.select("block", "bucket", "n", "flags", "hot").unionByName(copies)
    sort_in = max(LEAST_BUCKETS, size // SORTED)
    bodies = blocks.drop("size")
    sent = bodies.groupBy("block").cogroup(info.groupBy("block")).applyInArrow(lambda b, i: _around(b, i, sort_in), "bucket int, kind int, block long, blob binary")
    return bodies, sent.groupBy("bucket").applyInArrow(_judge, "block long, blob binary")


def remove_repeats(docs: DataFrame, texts: bool = True, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of each row of ``docs``.

    Only ``doc_id`` and ``text`` are read. Removed is each byte of a 50-byte
    string that starts in a document with a smaller id too, by the texts as
    given; ``spans`` are the removed ranges of the UTF-8 and ``kept`` (left
    out if ``texts`` is false) is the rest. Null texts are empty; texts under
    50 bytes keep all. A row without an id keeps all and takes nothing from
    others. Rows that share an id take nothing from each other. An empty
    table gives an empty table.
    """
    blocks, marks = marked(docs.select(F.col("doc_id").cast("long"), "text"), block_bytes, hot)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * texts
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda b, m: _report(b, m, texts), out)


def cut_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, all columns as they are but ``text``, which loses what ``remove_repeats`` finds.

    A character that is cut in two goes as a whole; a null text becomes empty.
    ``doc_id`` must be a long.
    """
    names = docs.columns
    blocks, marks = marked(docs, block_bytes, hot)
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda b, m: _replace(b, m, names), docs.schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: what is removed from every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("spans")


#: The least document of each 50-byte window, runs of the windows to remove, and the pieces between.
SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, b[i + 1:i + {LENGTH}] AS s FROM (SELECT doc_id, b, unnest(range(size - {LENGTH - 1})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s) USING (s) WHERE doc_id > least),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM hit)),
span AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM (SELECT doc_id, a, z FROM span UNION ALL SELECT doc_id, size, NULL FROM d)),
kept AS (SELECT doc_id, string_agg(hex(b[p + 1:a]), '' ORDER BY a, p) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, size AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM span GROUP BY doc_id) USING (doc_id)"""
