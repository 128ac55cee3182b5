"""The ten operators and the pipeline against plain Python, SQL and the libraries."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import same
from wavetable.llm import blocks, bpe, components, gear, host_rules, jaccard, media, mixture, nbsvm, registry, sharing, shards, suffixes, token_counts

#: Names that operators use inside.
CLASHES = "host string, n_words long, kept boolean, score double, ids binary, class long, key long, row long, _p double, probability double, sampled boolean, spans string, block long, n_tokens long, _kept long, hot int, note string, clips string"
PASSAGE = " ".join(f"word{i} of the long repeated passage" for i in range(12))


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    texts = [
        (1, "An ordinary text of some words that says nothing new and then ends."), (2, "An ordinary text of some words that says nothing new and then ends."), (3, None), (4, ""), (5, "   \n\t "),
        (6, long), (7, long + " and more"), (8, "x" * 70_000), (9, " " * 40_000 + "a"), (None, "A text without an id."), (None, None), (1, "An ordinary text of some words that says nothing new and then ends."),
        (10, "short"), (11, "short"), (12, "<|endoftext|> inside <|endoftext|>"), (13, "é漢字😀 mixed͸ scripts"), (14, "one " + PASSAGE), (15, "another start " + PASSAGE + " another end"), (16, "a\x00b\x1f\x85c"),
    ]
    return [(d, t, "en", "s" if d != 4 else None, len(t or "")) for d, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "n_chars")
    for c in CLASHES.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


OPERATORS = {
    1: lambda d, _: shards.training_shards(d, stride=64, shard=16, spread=2),
    2: lambda d, _: host_rules.host_rules(d),
    3: lambda d, _: gear.dedupe_chunks(d),
    4: lambda d, x: nbsvm.quality_scores(d, x),
    5: lambda d, _: bpe.token_digests(d),
    6: lambda d, _: token_counts.token_counts(d),
    7: lambda d, _: jaccard.jaccard_components(d, jaccard.Rule(3, 90, 100)),
    8: lambda d, _: media.media_clips(d),
    9: lambda d, _: suffixes.remove_repeats(d),
    10: lambda d, _: mixture.mix(d),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_odd_inputs(odd, labels, n):
    rows = OPERATORS[n](odd, labels).collect()
    if n == 1:
        assert sum(r.n_slots for r in rows) == sum(len(r.doc_ids) for r in rows)
        assert {d for r in rows for d in r.doc_ids} == {d for d, t, *_ in odd_rows() if t}
        return
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, *_ in odd_rows())
    assert not [r for r in rows if isinstance(r, tuple) and len(r) == 0]


@pytest.mark.parametrize("n", OPERATORS)
def test_empty_table(odd, labels, n):
    assert OPERATORS[n](odd.where("doc_id = 999"), labels).count() == 0
    if n == 4:
        assert {r.score for r in OPERATORS[n](odd, labels.where("doc_id = 999")).collect()} == {0.5}


def test_blocks():
    a = pa.array(["ab", None, "", "cde"])
    raw, off = blocks.utf8(a.slice(1))
    assert raw.tobytes() == b"cde" and off.tolist() == [0, 0, 0, 3]
    assert blocks.span_index(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    packed = blocks.pack([np.arange(3), np.zeros(0, np.int32)])
    assert [x.tolist() for x in blocks.unpack(packed, [np.int64, np.int32])] == [[0, 1, 2], []]


# 1 training order


@given(st.integers(1, 3000), st.integers(0, 1 << 40))
@settings(max_examples=25, deadline=None)
def test_permutation(n, key):
    x = shards.permute(np.arange(n), n, key)
    assert sorted(x.tolist()) == list(range(n)) and (shards.permute(x, n, key, inverse=True) == np.arange(n)).all()


def test_shards_round_trip(spark, docs, tmp_path):
    out = shards.training_shards(docs, stride=64, shard=32, spread=2).cache()
    shards.write_shards(out, str(tmp_path / "s"))
    total = sum(r.n_slots for r in out.collect())
    rows = shards.read_slots(spark, str(tmp_path / "s"), 0, total).collect()
    assert sorted(r.slot for r in rows) == list(range(total))
    e = bpe.encoder(bpe.RANKS)
    want = collections.Counter()
    for r in docs.collect():
        ids = e.whole.encode_ordinary(r.text or "")
        for i in range(0, len(ids), 64):
            part = ids[i : i + 64]
            want[r.doc_id, np.array(part + [shards.PAD] * (64 - len(part)), "<u2").tobytes()] += 1
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    some = shards.read_slots(spark, str(tmp_path / "s"), 40, 70).collect()
    assert sorted(r.slot for r in some) == list(range(40, 70))
    assert {(r.slot, bytes(r.ids)) for r in some} <= {(r.slot, bytes(r.ids)) for r in rows}


# 2, 7, 9 and 10 have SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, sf, name):
    same(registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["op2_host_rules", "op10_mixture"])
def test_sql_on_odd_rows(spark, odd, tmp_path, name):
    import duckdb

    # The SQL tells documents apart by their ids.
    odd.select("doc_id", "text", "lang", "source").where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name]))


def test_host_is_rejected(spark):
    good = "this text has quite a lot of different words so that no rule has any reason to fail it at all {}"
    rows = [(i, "bad words only" if i % 10 else good.format(i), "spam") for i in range(200)] + [(1000 + i, good.format(i), f"h{i % 20}") for i in range(200)]
    out = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r.kept for r in out if r.doc_id < 1000) and all(r.kept for r in out if r.doc_id >= 1000)


def test_plan_is_native(docs):
    out = mixture.mix(docs).toPandas()
    assert (out.probability * out.n_tokens).sum() == pytest.approx(mixture.BUDGET * out.n_tokens.sum(), rel=1e-6)
    plan = mixture.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def tied_rows():
    """Cells of sources that are nearly tied to one language each, of quite different sizes."""
    sizes, rng = [40_000, 9_000, 6_000, 4_000, 3_000, 2_000, 1_000, 500], random.Random(5)
    return [(0, f"s{s}", f"l{k}", t, int(n * (0.99 if k == s % 2 else 0.01) * (0.5 + rng.random()))) for s, n in enumerate(sizes) for k in range(2) for t in ("a", "b", "c")]


CELLS = "doc_id long, source string, lang string, topic string, n_tokens long"


def test_raking_of_tied_sources_meets_targets(spark, caplog):
    cells = mixture.rake(spark.createDataFrame(tied_rows(), CELLS), budget=0.01)
    got = mixture.marginals(cells).toPandas()
    assert len(got) == 8 + 2 + 3 and np.allclose(got.reached, got.target, rtol=1e-7, atol=0)
    rows = cells.toPandas()
    assert (rows.weight <= rows.n_tokens).all() and rows.weight.sum() == pytest.approx(0.01 * rows.n_tokens.sum())
    assert not caplog.records


@pytest.mark.parametrize("few", [100_000, 1])
def test_raking_to_given_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixture, "FEW_CELLS", few)
    shares = {"lang": {"l0": 3.0, "l1": 1.0}, "topic": {"a": 1.0, "b": 1.0}}
    rows = mixture.rake(spark.createDataFrame(tied_rows(), CELLS), {"lang": 0.9, "topic": 0.9}, 0.2, targets=shares).toPandas()
    total = 0.2 * rows.n_tokens.sum()
    lang, topic = rows.groupby("lang").weight.sum() / total, rows.groupby("topic").weight.sum() / total
    assert lang["l0"] == pytest.approx(0.75) and topic["a"] == pytest.approx(0.5) and topic["c"] < 1e-9


def test_raking_reports_contradicting_targets(spark, caplog):
    rows = [(0, "s0", "l0", "a", 900), (0, "s1", "l1", "a", 50), (0, "s1", "l0", "b", 50)]
    got = mixture.marginals(mixture.rake(spark.createDataFrame(rows, CELLS), budget=0.3)).toPandas()
    assert (got.reached / got.target - 1).abs().max() > 1e-3 and "off its target" in caplog.text


def test_sample_meets_targets(docs):
    out = mixture.mix(docs).toPandas()
    out["kept"] = out.probability * out.n_tokens
    assert out.probability.max() <= 1 and (out.probability == 1).sum() > 20
    for d, p in mixture.POWERS.items():
        n, got = out.groupby(d).n_tokens.sum(), out.groupby(d).kept.sum()
        free = (n**p).where(got < n * (1 - 1e-7), 0.0)
        rest = mixture.BUDGET * n.sum() - n[free == 0].sum()
        assert np.allclose(got[free > 0], (rest * free / free.sum())[free > 0], rtol=1e-6)
        assert (n[free == 0] ** p * rest / free.sum() >= n[free == 0] * (1 - 1e-6)).all()


# 3 chunks


def test_gear_hash_and_shift():
    raw = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    h, got = 0, []
    for b in raw.tolist():
        h = ((h << 1) + int(gear.GEAR[b])) & 0xFFFFFFFF
        got.append(h)
    assert got == gear.gear_hash(raw).tolist()
    ends = set(gear.chunks(raw))
    moved = {e - 7 for e in gear.chunks(np.concatenate([np.zeros(7, np.uint8), raw]))}
    assert len(ends & moved) > 0.9 * len(ends)


def brute_chunks(rows):
    """What ``dedupe_chunks`` removes, row by row in its order; rows without an id in the given one."""
    import xxhash

    def key(r):
        return (r[0] is None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))) if r[0] is not None and r[1] is not None else 42 if r[0] is not None else 0)

    seen, done, out = set(), {}, collections.Counter()
    for d, t in sorted(rows, key=key):
        body, last, later = (t or "").encode(), 0, []
        if d is None or (d, t) not in done:
            for e in gear.chunks(np.frombuffer(body, np.uint8)):
                if body[last:e] in seen:
                    later.append((last, e - last))
                seen.add(body[last:e])
                last = e
            a = np.array(later, np.int64).reshape(-1, 2)
            first, end = gear.runs(a[:, 0], a[:, 1], whole=len(body))
            stay = np.ones(len(body), bool)
            for x, y in zip(first, end):
                stay[x:y] = False
            done[d, t] = np.frombuffer(body, np.uint8)[stay].tobytes()
        out[d, done[d, t], hashlib.sha256(done[d, t]).hexdigest()] += 1
    return out


def test_chunk_dedup(docs, odd, spark):
    same = random.Random(4).randbytes(3000).hex()
    more = spark.createDataFrame([(None, same), (None, same), (7, same[:2000]), (7, same[1000:]), (7, same[1000:]), (3, "short"), (4, "short"), (5, "")], "doc_id long, text string").coalesce(1)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        got = collections.Counter((r.doc_id, bytes(r.kept), r.kept_sha256) for r in gear.dedupe_chunks(df).collect())
        assert got == brute_chunks([(r.doc_id, r.text) for r in df.collect()])
    got = gear.dedupe_chunks(more).collect()
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [6000, 6000]
    assert [r.n_removed for r in got if r.doc_id == 4] == [5]


# 4 classifier


def test_quality_held_out(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    d, x = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = nbsvm.quality_scores(d, x).join(x, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    found = [np.unique(np.concatenate([rng.integers(0, 500, 30), [600 + (i % 2)]])).astype(np.int32) for i in range(200)]
    label = np.arange(200) % 2
    m = nbsvm.fit(found, label)
    assert ((m.score(found) >= 0.5) == (label == 1)).all()


def test_fit_by_brute_force():
    """Ratios counted one by one, and the primal of the hinge loss next to one that long projected ascent reaches."""
    rng = np.random.default_rng(3)
    words = rng.permutation(1 << nbsvm.BITS)[:120]
    found = [np.unique(words[rng.integers(0, 80, 25) + (20 if i % 2 else 0)]).astype(np.int32) for i in range(60)]
    label = (np.arange(60) + (rng.random(60) < 0.1)) % 2
    m = nbsvm.fit(found, label, passes=300)
    y = np.where(label == 1, 1.0, -1.0)
    p, q = ({k: 1 + sum(k in f for f, v in zip(found, y) if v == s) for k in words.tolist()} for s in (1, -1))
    a, b = (sum(x.values()) + (1 << nbsvm.BITS) - len(words) for x in (p, q))
    ratio = {k: np.log(p[k] / a) - np.log(q[k] / b) for k in words.tolist()}
    cols = sorted(ratio)
    x = np.array([[ratio[k] * (k in f) / len(f) ** 0.5 for k in cols] + [1.0] for f in found])
    alpha = np.zeros(60)
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    top = np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / top, 0, nbsvm.COST)
    best = alpha.sum() - alpha @ gram @ alpha / 2
    w = np.array([m.weights[k] / ratio[k] if ratio[k] else 0.0 for k in cols] + [m.bias])
    primal = w @ w / 2 + nbsvm.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    assert best * (1 - 1e-9) <= primal <= best * 1.01
    margin = x @ w
    assert np.allclose(m.score(found), 1 / (1 + np.exp(-nbsvm.STEEP * margin)), atol=1e-4)


def test_quality_of_odd_rows(spark, odd, labels):
    got = nbsvm.quality_scores(odd, labels).collect()
    score = collections.defaultdict(set)
    for r in got:
        score[r.doc_id].add(r.score)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert score[1] == score[2] and score[3] == score[4] <= score[None] and score[10] == score[11]
    rows = [(1, "the first text"), (1, "another text"), (2, "x"), (3, "the first text")]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    mark = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    want = nbsvm.quality_scores(once, mark).collect()
    many = nbsvm.quality_scores(spark.createDataFrame(rows * 20, "doc_id long, text string"), mark).collect()
    assert {(r.doc_id, r.score) for r in many} == {(r.doc_id, r.score) for r in want}


# 5 and 6 tokens


@given(st.lists(st.sampled_from(list("ab .'\n1é ") + ["'s", "'re", "xxxxxxx", "    "]), max_size=80).map("".join), st.integers(3, 40), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_stitch(text, chunk, overlap):
    split = bpe.encoder(bpe.RANKS).split
    parts = [(a, b, bpe.boundaries(b, a, split)) for a, b in bpe.chunked(text, chunk, overlap)]
    assert list(bpe.stitch(parts, split)) == split(text)


@pytest.mark.parametrize("chunk,overlap", [(32_768, 512), (300, 20)])
def test_bpe(docs, odd, chunk, overlap):
    whole = bpe.encoder(bpe.RANKS).whole
    for df in (docs, odd):
        got = bpe.decode_ids(bpe.encode_texts(df, chunk=chunk, overlap=overlap)).collect()
        want = collections.Counter((r.doc_id, np.array(whole.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in df.collect())
        assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_token_counts(docs, odd):
    library = token_counts.counts(token_counts.TOKENIZER).library
    for df in (docs, odd):
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df).collect()) == want


# 7 near duplicates


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, rule):
    sets = [shingles(r.text, rule.width) if r.doc_id is not None else frozenset() for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        near = collections.Counter(j for g in s for j in where[g])
        for j, n in near.items():
            if rule.den * n >= rule.num * len(s | sets[j]):
                root[top(i)] = top(j)
        for g in s:
            where[g].append(i)
    by_id = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            root[top(i)] = top(by_id.setdefault(r.doc_id, i))
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(i)] = min(least.get(top(i), 1 << 62), r.doc_id)
    return collections.Counter((r.doc_id, len(shingles(r.text, rule.width)), least[top(i)] if r.doc_id is not None else None) for i, r in enumerate(rows))


def variants(seed=2):
    """Families of texts with few words changed, about both thresholds."""
    rng, out = random.Random(seed), []
    for f in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 160]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 12)):
                t[rng.randrange(len(t))] = f"v{rng.randrange(40)}"
            out.append((len(out), " ".join(t)))
    return out + [(5, "an id with a second text of its own"), (90, "an id with a second text of its own")]


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100)])
def test_jaccard(spark, docs, odd, rule):
    made = spark.createDataFrame(variants(), "doc_id long, text string")
    for df in (made, docs.select("doc_id", "text"), odd):
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, rule).collect())
        assert got == brute(df.collect(), rule)


def test_tiles_in_two_blocks():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[i:], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for i in range(0, 40, 4)]
    rule = jaccard.Rule(3, 90, 100)
    whole, _ = jaccard.link_tile(sets, np.zeros(len(sets), int), rule)
    assert len(set(whole.tolist())) == 1
    halves, _ = jaccard.link_tile(sets, np.arange(len(sets)) % 2, rule)
    assert len(set(halves.tolist())) == 1


def near_copies(many, words, changes, seed):
    """Copies of one text with a few words replaced each, some too far off to link, and some of which link only with each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(many):
        t = list(base)
        for _ in range(rng.randrange(changes) if i % 20 else words // 8):
            t[rng.randrange(words)] = f"c{rng.randrange(50)}"
        out.append((i, " ".join(t)))
    return out + [(many + i, " ".join(base[: words // 2] + [f"d{j}" for j in range(words // 2)] + ["e"] * (i % 2))) for i in range(40)]


def by_matrix(rows, rule):
    """Components of texts by the product of their 0-1 matrix."""
    sets = [shingles(t, rule.width) for _, t in rows]
    number = {}
    x = np.zeros((len(sets), len(set().union(*sets))), np.float32)
    for i, s in enumerate(sets):
        x[i, [number.setdefault(g, len(number)) for g in s]] = 1
    common, size = x @ x.T, x.sum(axis=1)
    links = rule.den * common >= rule.num * (size[:, None] + size[None] - common)
    left, out = np.ones(len(sets), bool), {}
    for i, (d, _) in enumerate(rows):
        if left[i]:
            seen = new = links[i] & left
            while new.any():
                grown = links[new].any(axis=0) & left & ~seen
                seen, new = seen | grown, grown
            left &= ~seen
            out |= {rows[k][0]: d for k in np.flatnonzero(seen).tolist()}
    return out


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100)])
@pytest.mark.parametrize("many,sets", [(400, 16), (5000, 512)])
def test_large_group_in_many_blocks(spark, rule, many, sets):
    rows = near_copies(many, 200, 4 if rule.num == 90 else 6, many)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rule, jaccard.Tiling(sets, 1 << 20)).collect()
    want = by_matrix(rows, rule)
    assert len(set(want.values())) > 20 and {r.doc_id: r.component_id for r in got} == want


@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.randoms())
@settings(max_examples=200, deadline=None)
def test_prefixes_of_linked_sets_meet(size, own, other, rng):
    rule = rng.choice([jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100)])
    every = np.random.default_rng(rng.randrange(1 << 30)).integers(0, 1 << 63, size + own + other).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(every[: size + own]), np.unique(np.concatenate([every[:size], every[size + own :]]))]
    common = {int(x) for x in every[:size] if rng.random() < 0.5}
    keys = []
    for x in sets:
        low = x[x < np.uint64(rule.sampled())]
        bits = [[int(v) in set(every[:size].tolist()) for v in low], [int(v) in common for v in low]]
        keys.append(set(jaccard.prefix_keys(x, np.concatenate([np.packbits(np.array(b, bool)) for b in bits]).tobytes(), rule).tolist()))
    if rule.links(size, len(sets[0]), len(sets[1])):
        assert keys[0] & keys[1]


@pytest.mark.parametrize("few", [components.FEW, 5, 0])
def test_components(spark, few):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), few).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {x: top(x) for x in list(root)}


def test_sharing(spark):
    keys = [np.unique(np.random.default_rng(s).integers(0, 1 << 63, 200).astype(np.uint64)) for s in range(3)]
    keys[1] = np.unique(np.concatenate([keys[1], keys[0][:50]]))
    rows = [(r["block"], r["bucket"], r["n"], r["note"], r["prints"]) for b, k in enumerate(keys) for r in sharing.print_rows(b, k, 4).to_pylist()]
    out = sharing.mark_shared(spark.createDataFrame(rows, "block long, bucket int, n int, note binary, prints binary"), hot=1).collect()
    for b, k in enumerate(keys):
        flags = sharing.flags_of(sorted((r.asDict() for r in out if r.block == b), key=lambda r: r["bucket"]))
        others = np.concatenate([x for i, x in enumerate(keys) if i != b])
        assert (flags == np.isin(k, others)).all()


# 8 media


def cuts(samples):
    """The shots one frame after the other, from counted histograms."""
    h = [[int(((x.ravel() >> 4) == b).sum()) for b in range(media.BINS)] for x in samples]
    change = [sum(abs(a - b) for a, b in zip(x, y)) / samples[0].size for x, y in zip(h, h[1:])]
    out, first = [], 0
    for i, c in enumerate(change):
        old = [min(x, media.CAP) for x in change[max(0, i - media.WINDOW) : i]]
        if i >= 2:
            mean = sum(old) / len(old)
            dev = max(0.0, sum(x * x for x in old) / len(old) - mean * mean) ** 0.5
            if c > mean + max(media.FLOOR, media.SIGMAS * dev) + 1e-12:
                out.append((first, i + 1))
                first = i + 1
    return [*out, (first, len(samples))]


def test_media(docs, odd):
    for df in (docs, odd):
        texts = collections.defaultdict(set)
        for r in media.media_clips(df, keep_media=True).collect():
            stored, fps = media.read_avi(bytes(r.media))
            assert fps == 25 and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
            assert hashlib.sha256(media.decode_frames(stored).tobytes()).hexdigest() == r.payload_sha256
            assert r.clips[0].first_frame == 0 and r.clips[-1].end_frame == len(stored) == r.payload_bytes // 576
            assert r.media_bytes == len(r.media) and [(c.first_frame, c.end_frame) for c in r.clips] == cuts(media.decode_frames(stored))
            assert all((c.start_s, c.end_s) == (c.first_frame / fps, c.end_frame / fps) for c in r.clips)
            assert r.tail_crc32 == zlib.crc32(media.decode_frames(stored).tobytes()[-32:])
            texts[r.doc_id].add(r.payload_sha256)
        for r in df.collect():
            b = (r.text or "").encode()
            assert hashlib.sha256(b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))).hexdigest() in texts[r.doc_id]


def test_slow_decoder_agrees():
    x = np.random.default_rng(1).integers(0, 256, (2, 24, 24)).astype(np.uint8)
    x[1, :5] = 255
    frames = media.encode_frames(x)
    assert (media.decode_frames(frames) == x).all() and (np.stack([media._decode_any(f) for f in frames]) == x).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....WAVE")


def test_shots():
    dark, light = np.full((10, 24, 24), 20, np.uint8), np.full((8, 24, 24), 220, np.uint8)
    assert media.shots(np.concatenate([dark, light, dark])) == [(0, 10), (10, 18), (18, 28)]


# 9 repeats


def brute_repeats(rows):
    least = {}
    for r in rows:
        b = (r.text or "").encode()
        for i in range(len(b) - 49 if r.doc_id is not None else 0):
            w = b[i : i + 50]
            least[w] = min(least.get(w, r.doc_id), r.doc_id)
    out = collections.Counter()
    for r in rows:
        b = (r.text or "").encode()
        stay = np.ones(len(b), bool)
        for i in range(len(b) - 49 if r.doc_id is not None else 0):
            if least[b[i : i + 50]] < r.doc_id:
                stay[i : i + 50] = False
        runs = int((np.diff(np.concatenate([[1], stay.astype(int)])) == -1).sum())
        out[r.doc_id, len(b), int((~stay).sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[stay].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block,hot", [(2 << 20, 128), (20_000, 1)])
def test_repeats(docs, odd, block, hot):
    for df in (docs, odd):
        got = suffixes.remove_repeats(df, block_bytes=block, hot=hot).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(df.collect())
        assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_strings_shorter_than_the_length_are_kept(spark):
    rng = random.Random(8)
    for n in (20, 32, 45, 49, 50):
        a, b, c = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (650, 650, n))
        df = spark.createDataFrame([(1, a + c + b), (2, b[::-1] + c + a[::-1])], "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(df).collect()}
        assert got == {1: 0, 2: 50 if n == 50 else 0}


def test_passage_behind_many_bytes(spark):
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage = letters(4000)
    rows = [(1, letters(100) + passage), (2, letters(17_900_000) + passage + letters(30)), (3, passage[5:4000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans]) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).collect()}
    assert got == {1: (4100, 0, []), 2: (17_904_030, 4000, [(17_900_000, 17_904_000)]), 3: (3995, 3995, [(0, 3995)])}


def test_cut_keeps_columns(odd):
    got = suffixes.cut_repeats(odd)
    assert got.schema.names == odd.schema.names and got.count() == len(odd_rows())
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[14] == "one " + PASSAGE and "repeated passage" not in text[15] and text[15].startswith("another start")


@given(st.binary(min_size=60, max_size=300).map(lambda b: bytes(x % 2 + 97 for x in b)))
@settings(max_examples=50, deadline=None)
def test_suffix_order(body):
    raw = np.frombuffer(body, np.uint8)
    at = np.arange(len(raw) - 49)
    rank, lcp = suffixes.suffix_order(raw, at)
    cut = [body[i : i + 50] for i in at[rank]]
    assert cut == sorted(cut)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 50)

    assert lcp.tolist()[1:] == [common(a, b) for a, b in zip(cut, cut[1:])]
    doc = np.random.default_rng(len(body)).integers(0, 4, len(at))
    least = {}
    for c, d in zip(cut, doc):
        least[c] = min(least.get(c, 9), d)
    assert suffixes.previous_factors(doc, lcp).tolist() == [least[c] < d for c, d in zip(cut, doc)]


@pytest.mark.parametrize("kind", ["words", "one letter", "two letters"])
def test_anchors_beyond_the_place_bits(kind):
    rng = random.Random(3)
    body = {"words": rng.randbytes(3000), "one letter": b"a" * 3000, "two letters": bytes(97 + (rng.random() < 0.1) for _ in range(3000))}[kind]
    raw = np.frombuffer(body, np.uint8)
    off = np.array([0, 1500, 1530, 3000])
    starts, place, key = suffixes.anchors(raw, off, bits=10)
    assert len(starts) == 1451 + 1421
    for s, p in zip(starts.tolist(), place.tolist()):
        _, (alone,), k = suffixes.anchors(raw[s : s + 50], np.array([0, 50]), bits=10)
        assert p - s == alone and key[p] == k[alone]


# pipeline


def test_pipeline_stages(spark, sf, docs, odd):
    import corpus_pipeline as p

    rows = {r.doc_id: r for r in docs.collect()}
    model_keeps = {r.doc_id for r in nbsvm.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in p.quality(spark, docs, sf).collect()} == model_keeps
    want = {c for _, _, c in brute(list(rows.values()), p.NEAR)}
    assert {r.doc_id for r in p.near_duplicates(spark, docs, sf).collect()} == want
    cut = {r.doc_id: r for r in p.repeated_passages(spark, docs, sf).collect()}
    for r in suffixes.remove_repeats(docs).collect():
        assert cut[r.doc_id].text == bytes(r.kept).decode("utf-8", "ignore") and cut[r.doc_id].n_chars == len(cut[r.doc_id].text)
    sampled = {r.doc_id for r in mixture.mix(docs).where("sampled").collect()}
    assert {r.doc_id for r in p.mixture(spark, docs, sf).collect()} == sampled
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names
        assert stage(spark, odd, sf).schema.names == odd.schema.names, name
        assert stage(spark, odd.where("doc_id = 999"), sf).count() == 0
    out = p.run(spark, sf).collect()
    table = {i: b for b, i in ((base64.b64decode(a), int(b)) for a, b in map(bytes.split, open(bpe.RANKS, "rb")))}
    for r in out:
        assert hashlib.sha256(b"".join(table[i] for i in np.frombuffer(bytes(r.ids), "<u4").tolist())).hexdigest() == r.decoded_sha256
    assert out and {r.doc_id for r in out} <= model_keeps
