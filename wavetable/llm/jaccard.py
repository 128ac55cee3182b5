"""N-gram Jaccard join in size-banded tiles with bitmap signatures.

A document is the set of its distinct word shingles, hashed to 64 bits.
Two exact bounds find candidates. A set that links with another shares most
of its shingles, so one of which too many occur nowhere else is out; a fixed
range of the hashes is enough to tell for most. Two sets that link have one
shingle at least in common among the first few of each, in any one order of
all shingles; the order here is by rarity (in no other set, in few blocks of
documents, in many), so that few sets meet by chance. Sets that meet form
groups; groups that overlap are cut into blocks of consecutive sizes, and
pairs of blocks whose sizes can link are tiles. In a tile the bit counts of
hashed bitmaps bound each overlap from above, and only pairs that pass and
are not yet connected get the exact intersection of their sorted arrays.
Equal sets are one node throughout.

In a group of several blocks the links inside blocks come first, then those
between the sets that stand for what is connected by then, dealt to other
blocks each round. What is left over is compared with all the rest, so that a
large group of near copies costs in proportion to its size, and only sets
that link with few of their group cost a comparison with all of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetable.llm.blocks import gathered, groups, mix64, narrow, pack, release, tidy, unpack
from wavetable.llm.components import components
from wavetable.llm.host_rules import words
from wavetable.llm.sharing import buckets_for, flags_of, mark_shared, print_rows
from wavetable.session import stable

#: Text bytes of a block of documents, and the blocks beside its own in which a shingle is common.
BLOCK_BYTES, COMMON = 16 << 20, 8


@dataclass(frozen=True)
class Tiling:
    """Sets and shingles of a block, as expected; a tile is two blocks at most."""

    sets: int = 1024
    shingles: int = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; a link needs ``den * intersection >= num * union``."""

    width: int = 5
    num: int = 80
    den: int = 100

    def largest(self, size):
        """The largest set that one of ``size`` can link with."""
        return size * self.den // self.num

    def prefix(self, size):
        """How many of a set's first shingles have one in common with those of any set it links with."""
        return size - (size * self.num + self.den - 1) // self.den + 1

    def share(self):
        """The share of the hash range that tells whether a set may link: twice what a linked set can have alone, and a little more."""
        return min(1.0, 2.2 * (self.den - self.num) / self.den)

    def sampled(self):
        return min((1 << 64) - 1, int(self.share() * 2.0**64))

    def stretch(self):
        """Spreads sampled hashes over the whole range, order kept."""
        return max(1, int(1 / self.share()))

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text; A to Z count as a to z."""
    n = len(texts)
    doc, flat = words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = flat.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    h = each[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=n)
    end = np.cumsum(count)
    full = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for j in range(width):
        full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j]) if len(full) else full
    out = []
    for k, e in zip(count.tolist(), end.tolist(), strict=True):
        if k >= width:
            out.append(np.unique(full[e - k : e - width + 1]))
        elif k:
            x = np.array([k], np.uint64)
            for w in h[e - k : e]:
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """A set's class: 64 bits of hash over its size and members, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).astype(np.int64))


def _blocks(batches: Iterable[pa.RecordBatch], rule: Rule, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, bucket, n, note, prints); one row's note has the block's documents, and which bucket's differs by block."""
    block = TaskContext.get().partitionId() << 32
    top, press = np.uint64(rule.sampled()), zstandard.ZstdCompressor(level=1)
    for whole in gathered(batches, BLOCK_BYTES):
        size, local, number, low = [], [], {}, []
        for part in groups([whole]):
            for x in shingle_sets(part.column("text"), rule.width):
                size.append(len(x))
                local.append(number.setdefault(class_of(x), len(number)))
                if len(low) < len(number):
                    low.append(x[: np.searchsorted(x, top)].copy())
        keys, entry, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        ids = whole.column("doc_id")
        step = np.diff(entry, prepend=0)
        arrays = [pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False), np.array(size, np.int64), np.array(list(number), np.int64), np.array(local, np.int32)]
        arrays += [(step & 0xFFFF).astype(np.uint16), (step >> 16).astype(np.int32), np.array([len(x) for x in low], np.int32), np.packbits(count > 1)]
        # Prints within a bucket stay distinct unless two keys share their 32 bits; those are decided as shared, which is safe.
        yield print_rows(block, keys * np.uint64(rule.stretch()), buckets, press.compress(pack(arrays)))
        block += 1


def _documents(table: pa.Table, rule: Rule) -> pa.Table:
    """(doc_id, n_shingles, class, ranks) of a block from its answered rows.

    One document of each class that may link has ``ranks``: a bit for each of
    its sampled shingles in the order of hashes, set if another set has it
    too, and then a bit for each, set if it is common.
    """
    tidy()
    rows = table.sort_by("bucket").to_pylist()
    note = zstandard.ZstdDecompressor().decompress(next(r["note"] for r in rows if r["note"] is not None))
    ids, valid, size, name, local, low, high, many, several = unpack(note, [np.int64, bool, np.int64, np.int64, np.int32, np.uint16, np.int32, np.int32, np.uint8])
    entry = np.cumsum(low + (high.astype(np.int64) << 16))
    shared, common = flags_of(rows), flags_of(rows, "hot")
    shared = (shared | np.unpackbits(several, count=len(shared)).astype(bool))[entry]
    common = common[entry]
    edge = np.concatenate([[0], np.cumsum(many)])
    alone = np.diff(np.concatenate([[0], np.cumsum(~shared)])[edge])
    ranks, done = [None] * len(ids), np.zeros(len(name), bool)
    for i in np.flatnonzero(valid & (size > 0) & (alone[local] * rule.den <= size * (rule.den - rule.num))).tolist():
        k = local[i]
        if not done[k]:
            done[k] = True
            ranks[i] = np.concatenate([np.packbits(x[edge[k] : edge[k + 1]]) for x in (shared, common)]).tobytes()
    release()
    return pa.table({"doc_id": pa.array(ids, mask=~valid), "n_shingles": size, "class": pa.array(name[local], mask=size == 0), "ranks": pa.array(ranks, pa.binary())})


def document_classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, class, ranks) of each row; without ``ranks`` in any row a class links with none."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = buckets_for(size / 6 * rule.share())
    rows = narrow(docs).mapInArrow(lambda it: _blocks(it, rule, buckets), "block long, bucket int, n int, note binary, prints binary")
    return mark_shared(rows, COMMON).groupBy("block").applyInArrow(lambda t: _documents(t, rule), "doc_id long, n_shingles long, class long, ranks binary")


def prefix_keys(members: np.ndarray, ranks: bytes, rule: Rule) -> np.ndarray:
    """The shingles in a set's prefix that another set has too, by rarity and hash."""
    m = int(np.searchsorted(members, np.uint64(rule.sampled())))
    bits = np.unpackbits(np.frombuffer(ranks, np.uint8)).reshape(2, -1)[:, :m] if m else np.zeros((2, 0), np.uint8)
    rank = np.full(len(members), 3, np.uint8)
    rank[:m] = bits[0] + bits[1]
    first = np.argsort(rank, kind="stable")[: rule.prefix(len(members))]
    return members[first[rank[first] > 0]]


def _sets(batches: Iterable[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        sets = shingle_sets(part.column("text"), rule.width)
        there = np.array([class_of(s) if len(s) else 0 for s in sets]) == part.column("class").to_numpy()
        where = np.flatnonzero(there).tolist()
        at = pa.array(where, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("class").take(at), pa.array([len(sets[i]) for i in where], pa.int64()), part.column("ranks").take(at), pa.array([sets[i].tobytes() for i in where], pa.binary())], names=["class", "n", "ranks", "members"])


def _keys(batches: Iterable[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for part in groups(batches, "members"):
        keys = [prefix_keys(np.frombuffer(m, np.uint64), r, rule) for m, r in zip(part.column("members").to_pylist(), part.column("ranks").to_pylist(), strict=True)]
        index = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), part.column("class").take(pa.array(index))], names=["key", "class"])


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` for each set, with the bit of each member's hash set."""
    out = np.zeros((len(sets), bits), np.uint8)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out[rows, (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def link_tile(sets: list[np.ndarray], block: np.ndarray, rule: Rule, known: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """A label for each set of a tile, equal where links connect them, and the number of exact intersections.

    In a tile of two blocks, pairs inside either block are left to its own
    tile. Sets of one ``known`` component are connected from the start.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, block = [sets[i] for i in order], block[order]
    size = np.array([len(s) for s in sets], np.int64)
    two = block.min() != block.max()
    bits = min(1 << 16, max(256, 1 << int(2 * size.max() - 1).bit_length()))
    maps = np.concatenate([bitmaps(sets[i : i + 256], bits) for i in range(0, len(sets), 256)])
    label, exact = np.arange(len(sets)), 0
    if known is not None:
        _, first, inverse = np.unique(known[order], return_index=True, return_inverse=True)
        label = first[inverse]
    for a in range(len(sets)):
        end = int(np.searchsorted(size, rule.largest(size[a]), "right"))
        b = np.arange(a + 1, end)
        b = b[(label[b] != label[a]) & ((block[b] != block[a]) | (not two))]
        if not len(b):
            continue
        differ = np.bitwise_count(maps[b] ^ maps[a]).sum(axis=1, dtype=np.int64)
        bound = (size[a] + size[b] - differ) // 2
        for k in b[rule.links(bound, size[a], size[b])].tolist():
            if label[k] == label[a]:
                continue
            exact += 1
            common = len(np.intersect1d(sets[a], sets[k], assume_unique=True))
            if rule.links(common, size[a], size[k]):
                label[label == label[k]] = label[a]
    out = np.empty(len(sets), np.int64)
    out[order] = order[label]
    return out, exact


def _link(table: pa.Table, rule: Rule) -> pa.Table:
    tidy()
    table = table.group_by("class").aggregate([("members", "min"), ("side", "min"), ("known", "min")])
    sets = [np.frombuffer(m, np.uint64) for m in table.column("members_min").to_pylist()]
    node, known = table.column("class").to_numpy(), table.column("known_min").to_numpy()
    label, _ = link_tile(sets, table.column("side_min").to_numpy(), rule, known)
    moved = np.flatnonzero(known != known[label])
    release()
    return pa.table({"a": known[moved], "b": known[label[moved]]}) if len(node) else pa.table({"a": node, "b": node})


def candidate_sets(docs: DataFrame, classes: DataFrame, rule: Rule, repeated: bool = True) -> DataFrame:
    """(class, n, ranks, members) of the classes that may link with another one; ``repeated``: whether ids may repeat."""
    chosen = classes.where("ranks is not null").groupBy("class").agg(F.min(F.struct("doc_id", "ranks")).alias("of")).select("class", "of.doc_id", "of.ranks")
    sets = docs.join(chosen, "doc_id").select("text", "class", "ranks").mapInArrow(lambda it: _sets(it, rule), "class long, n long, ranks binary, members binary")
    return sets.dropDuplicates(["class"]) if repeated else sets


def candidate_groups(sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, component) of the classes that share a key with another, joined over all their keys."""
    keys = sets.select("class", "ranks", "members").mapInArrow(lambda it: _keys(it, rule), "key long, class long")
    first = keys.groupBy("key").agg(F.min("class").alias("b"), F.max("class").alias("last")).where("b < last").drop("last")
    return components(keys.join(first, "key").select(F.col("class").alias("a"), "b"))


def numbered(nodes: DataFrame, tiling: Tiling, seed: int = 0) -> DataFrame:
    """``nodes`` (group, n, class, ...) with a ``block`` of about ``tiling`` each; consecutive sizes, hashes within a size.

    Only counts by group and size are put in order, so no task sees a group.
    """
    share = F.greatest(F.count("*") / tiling.sets, F.count("*") * F.col("n") / tiling.shingles)
    before = Window.partitionBy("group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = nodes.groupBy("group", "n").agg(share.alias("share")).withColumn("before", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    spread = F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 24)) / F.lit(1 << 24)
    return nodes.join(sizes, ["group", "n"]).withColumn("block", F.floor(F.col("before") + F.col("share") * spread)).drop("before", "share")


def _linked(sets: DataFrame, placed: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """Links between ``known`` components in the tiles that (class, side, known, *keys) places sets in."""
    tiled = sets.select("class", "members").join(placed.select("class", "side", "known", *keys), "class")
    return tiled.groupBy(*keys).applyInArrow(lambda t: _link(t, rule), "a long, b long")


def _left_over(nodes: DataFrame, sets: DataFrame, rule: Rule, tiling: Tiling) -> DataFrame:
    """Links between components of the same group, all pairs of sets compared but those in a group's largest component."""
    many = nodes.groupBy("group", "known").agg(F.count("*").alias("many"))
    main = many.groupBy("group").agg(F.max(F.struct("many", "known")).alias("of"), F.count("*").alias("parts")).where("parts > 1").select("group", F.col("of.known").alias("main"))
    sides = nodes.join(main, "group").withColumn("rest", F.col("known") != F.col("main")).drop("main")
    sides = sides.withColumn("whole", F.col("group")).withColumn("group", F.xxhash64("whole", "rest"))
    placed = stable(numbered(sides, tiling).withColumn("group", F.col("whole")))
    blocks = placed.groupBy("group", "rest", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = blocks.where("rest").alias("l"), blocks.alias("r")
    near = (F.col("l.group") == F.col("r.group")) & (F.col("r.low") * rule.num <= F.col("l.high") * rule.den) & (F.col("l.low") * rule.num <= F.col("r.high") * rule.den)
    tiles = left.join(right, near & (~F.col("r.rest") | (F.col("l.block") <= F.col("r.block"))))
    side = lambda x, to: tiles.select("l.group", F.col("l.block").alias("i"), F.col("r.block").alias("j"), F.col("r.rest").alias("same"), F.lit(to).alias("side"), F.col(f"{x}.rest").alias("rest"), F.col(f"{x}.block").alias("block"))
    sent = side("l", 0).unionByName(side("r", 1).where("not same or i < j"))
    at = placed.join(sent, ["group", "rest", "block"])
    return _linked(sets, at, ["group", "i", "j", "same"], rule)


def class_links(docs: DataFrame, classes: DataFrame, rule: Rule, tiling: Tiling = Tiling(), repeated: bool = True) -> DataFrame:
    """Links (a, b) between classes that connect exactly what all their links connect."""
    sets = stable(candidate_sets(docs, classes, rule, repeated))
    found = candidate_groups(sets, rule).select(F.col("node").alias("class"), F.col("component").alias("group"))
    nodes = stable(numbered(sets.select("class", "n").join(found, "class"), tiling).withColumn("known", F.col("class")))
    links = stable(_linked(sets, nodes.withColumn("side", F.lit(0)), ["group", "block"], rule))
    large = nodes.groupBy("group").agg(F.max("block").alias("most")).where("most > 0").select("group")
    nodes, before, seed, last = stable(nodes.drop("block").join(large, "group")), None, 0, False
    if nodes.isEmpty():
        return links
    sets = sets.select("class", "members")
    while True:
        known = nodes.drop("known").join(components(links).withColumnRenamed("node", "class"), "class", "left")
        nodes, seed = stable(known.withColumn("known", F.coalesce("component", "class")).drop("component"), nodes), seed + 1
        stand = numbered(nodes.where("class = known"), tiling, seed)
        count, most = stand.agg(F.count("*"), F.max("block")).first()
        if last or before is not None and count > before / 2:
            return links.unionByName(_left_over(nodes, sets, rule, tiling))
        # A round that has each group in one block has compared all that stand for something.
        before, last = count, not most
        links = stable(links.unionByName(_linked(sets, stand.withColumn("side", F.lit(0)), ["group", "block"], rule)))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), tiling: Tiling = Tiling()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Only ``doc_id`` and ``text`` are read. Texts without words have no
    shingles and link with nothing. Rows with equal sets of shingles link;
    rows that share an id count as one document. A row without an id links
    with nothing and has no component. An empty table gives an empty table.
    Two sets whose 64-bit class hashes meet by chance would count as equal.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    classes = stable(document_classes(docs, rule))
    docs = docs.where("doc_id is not null")
    known = classes.where("doc_id is not null and class is not null")
    # Ids with two texts tie their classes together.
    several = stable(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("n > 1"))
    links, tied = class_links(docs, known, rule, tiling, not several.isEmpty()), several.where("a != b")
    if not tied.isEmpty():
        links = links.unionByName(known.join(tied.select("doc_id", "a"), "doc_id").select("a", F.col("class").alias("b")))
    of_class = components(links)
    least = known.groupBy("class").agg(F.min("doc_id").alias("least")).join(of_class.withColumnRenamed("node", "class"), "class", "left")
    least = least.withColumn("component", F.coalesce("component", "class"))
    # Cut off from the join, so that a component of very many classes is a skewed join that Spark can split.
    smallest = stable(least.groupBy("component").agg(F.min("least").alias("component_id")))
    answer = least.join(smallest, "component").select("class", "component_id")
    out = classes.drop("ranks").join(answer, "class", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of each component's smallest id, and those without an id.

    Rows that share an id stay or go together.
    """
    found = jaccard_components(docs, rule).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """The query: components of all documents at 0.9 over three-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Rule(3, 90, 100))


#: All pairs of documents with a common shingle, those that link, and what they reach.
SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS a FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(a[i:i + 2], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 1, least(len(a) + 1, 2)))) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT l.doc_id AS x, r.doc_id AS y, count(*) AS c FROM s l JOIN s r ON l.g = r.g AND l.doc_id < r.doc_id GROUP BY ALL),
near AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
edge AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN edge ON x = doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""
