"""Operators against plain Python on small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavetable.functions import constants
from wavetable.operators import features, intervals, label, match, noise, phases, score, transform
from wavetable.params import PRESETS, Spectral
from wavetable.plans import detect as detectors
from wavetable.plans import denoise as denoisers
from wavetable.sources import files

RNG = np.random.default_rng(5)


def long(spark, traces):
    return spark.createDataFrame([(t, n, float(x)) for t, xs in traces.items() for n, x in enumerate(xs)], "tr string, n long, x double")


def test_constants():
    want = {1: [1.731038776, 2.173286788, 2.638629436, 6.057762265], 2: [2.106337182, 2.515026986, 2.951196371, 6.256376352]}
    for d, xs in want.items():
        assert [constants.threshold(d, r) for r in (3, 4, 5, 12)] == pytest.approx(xs, abs=1e-8)
    assert constants.divide(10, 3) == [(0, 2), (3, 5), (6, 9)]
    assert constants.bin_groups(17, 5)[0] == (0, 0) and constants.bin_groups(17, 5)[-1] == (16, 16)
    assert constants.in_band([(0, 0), (1, 5), (6, 9)], 5, 6) == [(1, 5), (6, 9)]
    assert constants.level_of(100, constants.least_count(100, None, 0.95)) == pytest.approx(0.95, abs=0.02)


@given(st.integers(1, 200), st.integers(1, 50))
def test_divisions_cover(n, length):
    for parts in (constants.divide(n, length), constants.divide_log(n, 1.0)):
        assert [i for a, b in parts for i in range(a, b + 1)] == list(range(n))


@pytest.mark.parametrize("mode", ["reflect", "symmetric", "replicate", "wrap", "zero"])
def test_stft(spark, mode):
    x = RNG.standard_normal(50)
    got = transform.stft(long(spark, {"a": x}), ["tr"], 8, 2, 16, mode=mode).toPandas()
    kind = {"replicate": "edge", "zero": "constant"}.get(mode, mode)
    y = np.pad(x, 4, mode=kind)
    for m in range(25):
        want = np.fft.rfft(y[m * 2 : m * 2 + 8] * transform.window(8), 16)
        part = got[got.m == m].sort_values("k")
        assert np.allclose(part.re + 1j * part.im, want)


def test_reconstruction(spark):
    traces = {"a": RNG.standard_normal(60), "b": RNG.standard_normal(60)}
    cells = transform.stft(long(spark, traces), ["tr"], 12, 3, 16)
    back = transform.istft(cells, ["tr"], 12, 3, 16, 60).toPandas()
    for t, x in traces.items():
        assert np.allclose(back[back.tr == t].sort_values("n").x, x)
    with pytest.raises(ValueError):
        transform.istft(cells, ["tr"], 12, 12, 16, 60)


def test_windows():
    for size in (8, 9, 24):
        for name, want in (("hamming", np.hamming), ("blackman", np.blackman), ("bartlett", np.bartlett), ("hann", np.hanning)):
            assert np.allclose(transform.window(size, name), want(size + 1)[:-1])
        assert np.allclose(transform.window(size, ("kaiser", 5.0)), np.kaiser(size + 1, 5.0)[:-1])
        for name in ("nuttall", "blackmanharris", "parzen", "cosine", "flattop", ("gaussian", 3.0), ("tukey", 0.5), ("general_hamming", 0.6)):
            w = transform.window(size, name)
            assert len(w) == size and np.allclose(w[1:], w[1:][::-1]) and w.max() <= 1 + 1e-6
    assert np.allclose(transform.window(8, ("tukey", 1.0)), transform.window(8)) and np.allclose(transform.window(8, ("general_hamming", 0.54)), transform.window(8, "hamming"))
    with pytest.raises(ValueError):
        transform.window(8, "saw")


@pytest.mark.parametrize("size,hop,mode", [(64, 16, "reflect"), (100, 30, "zero"), (24, 6, "wrap")])
def test_transform_over_many_chunks(spark, monkeypatch, size, hop, mode):
    monkeypatch.setattr(transform, "CHUNK", 128)
    x = RNG.standard_normal(1000)
    cells = transform.stft(long(spark, {"a": x}), ["tr"], size, hop, 128, mode=mode)
    y = np.pad(x, size // 2 + size, mode={"zero": "constant"}.get(mode, mode))[size:]
    got = cells.toPandas().sort_values(["m", "k"])
    assert got.m.max() == 999 // hop
    want = np.stack([np.fft.rfft(y[m * hop : m * hop + size] * transform.window(size), 128) for m in range(999 // hop + 1)]).ravel()
    assert np.allclose(got.re + 1j * got.im, want)
    back = transform.istft(cells, ["tr"], size, hop, 128, 1000).toPandas().sort_values("n")
    # Past the centre of the last window's tail samples are known only through the padding.
    assert np.allclose(back.x[: 999 // hop * hop], x[: 999 // hop * hop])


@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_window_sums(x, size):
    if len(x) >= size:
        got = intervals.window_sums(np.array(x, float), size)
        assert got.tolist() == [sum(x[i : i + size]) for i in range(len(x) - size + 1)]


def test_moving_average_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "CHUNK", 64)
    x = RNG.standard_normal(500)
    got = intervals.sta_lta(long(spark, {"a": x}), ["tr"], 40, 7).toPandas().sort_values("n")
    y = np.pad(x, (39, 6), mode="reflect") ** 2
    assert np.allclose(got.ratio, [y[i + 39 : i + 46].sum() / y[i : i + 40].sum() * 40 / 7 for i in range(500)])


def test_wavelet_coefficients(spark):
    x = RNG.standard_normal(96)
    got = transform.cwt(long(spark, {"a": x}), ["tr"], 0.5, 3).toPandas()
    freqs = transform.wavelet_frequencies(96, 0.5, 3)
    spectrum, f = np.fft.fft(x), np.fft.fftfreq(96, 0.5)
    for k, centre in enumerate(freqs):
        gain = np.array([2 * np.exp(-0.5 * (transform.MORLET * q / centre - transform.MORLET) ** 2) if q > 0 else 0 for q in f])
        part = got[got.k == k].sort_values("m")
        assert np.allclose(part.freq, centre) and np.allclose(part.re + 1j * part.im, np.fft.ifft(spectrum * gain))


def test_sparse_coding_minimises(spark):
    """The shrinkage has less of its objective than the trace's own coefficients and than none."""
    n = np.arange(240)
    x = np.sin(2 * np.pi * 0.1 * n) * (np.abs(n - 120) < 40) + 0.05 * RNG.standard_normal(240)
    back = transform.sparse_gabor(long(spark, {"a": x}), ["tr"], 24, 6, 0.3).toPandas().sort_values("n").x.to_numpy()
    assert np.corrcoef(back, x)[0, 1] > 0.9 and np.abs(back[:60]).max() < 0.1 < np.abs(x[:60]).max()


def test_debias_fits_what_is_left(spark):
    n = np.arange(240)
    x = np.sin(2 * np.pi * 0.125 * n) * (np.abs(n - 120) < 60)
    run = lambda **o: transform.sparse_gabor(long(spark, {"a": x}), ["tr"], 24, 6, 0.5, **o).toPandas().sort_values("n").x.to_numpy()
    plain, fitted = run(), run(debias=40)
    assert np.abs(fitted - x).sum() < 0.5 * np.abs(plain - x).sum()
    assert np.allclose(run(rounds=400, tolerance=1e-6), run(rounds=400), atol=1e-3)


def test_grid_has_no_silent_loss(spark):
    from wavetable.sources import traces

    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 2.0)], "tr string, n long, x double")
    assert sorted((r.n, r.x) for r in traces.fill_grid(rows, ["tr"], 6).collect()) == [(0, 1.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 2.0)]
    with pytest.raises(Exception, match="outside the grid"):
        traces.fill_grid(rows, ["tr"], 5).collect()


def test_persistence_in_octaves():
    place = np.array([(4, 0), (8, 0), (16, 0), (9, 1), (30, 5)])
    value = np.array([1.0, 3.0, 2.0, 0.5, 0.7])
    linear, _ = phases.persistence(value, place, (1, 1), 0.0)
    assert linear.tolist() == [0, 1, 2, 1, 4]
    wide, prominence = phases.persistence(value, place, (1, 1), 0.0, octaves=1.0)
    assert wide.tolist() == [1, 1, 1, 1, 4] and set(prominence) == {1, 4}


def test_wavelet_keeps_a_tone(spark):
    x = np.sin(2 * np.pi * 0.1 * np.arange(400)) * np.hanning(400)
    cells = transform.cwt(long(spark, {"a": x}), ["tr"], 1.0, 8)
    back = transform.icwt(cells, ["tr"], 8).toPandas().sort_values("n").x.to_numpy()
    assert np.abs(back - x).max() < 0.05


def test_filters(spark):
    n = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.02 * n), np.sin(2 * np.pi * 0.3 * n)
    got = transform.bandpass(long(spark, {"a": slow + fast}), ["tr"], 1.0, None, 0.1).toPandas().sort_values("n").x
    assert np.abs(got - slow)[20:-20].max() < 0.02
    env = transform.envelope(long(spark, {"a": fast}), ["tr"]).toPandas().sort_values("n").x
    assert np.abs(env - 1)[20:-20].max() < 0.1
    flat = transform.detrend(long(spark, {"a": 3 + 0.5 * n[:50]}), ["tr"]).toPandas()
    assert np.abs(flat.x).max() < 1e-9
    sparse = transform.sparse_gabor(long(spark, {"a": slow}), ["tr"], 24, 6, 1e-9).toPandas().sort_values("n").x
    assert np.abs(sparse - slow).max() < 1e-3


def sigma_loop(y, xi, lam, least, branch):
    y = np.sort(y)
    n = len(y)
    s = np.cumsum(y) / np.arange(1, n + 1) / lam
    hit = [r for r in range(1, n) if y[r - 1] <= s[r - 1] * xi < y[r]]
    after, before = [r for r in hit if r >= least], [r for r in hit if r < least]
    end = s[max(1, n - 1) - 1]
    if after:
        return s[after[0] - 1]
    if branch == "low" and before:
        return s[before[-1] - 1]
    return end if branch == "high" or n <= least + 1 else s[least]


@pytest.mark.parametrize("branch", ["high", "low", "original"])
@pytest.mark.parametrize("least", [3, 15, 30])
def test_noise_level(spark, branch, least):
    amp = np.abs(RNG.standard_normal((4, 20))) * (1 + 5 * (RNG.random((4, 20)) > 0.8))
    rows = [("a", k, m, float(amp[k, m])) for k in range(4) for m in range(20)]
    cells = spark.createDataFrame(rows, "tr string, k long, m long, amp double")
    got = {r.g: r.sigma for r in noise.level(noise.in_blocks(cells, [(k, k) for k in range(4)], 20, 20), ["tr"], 4.0, least, branch).collect()}
    for k in range(4):
        d = 1 if k in (0, 3) else 2
        assert got[k] == pytest.approx(sigma_loop(amp[k], constants.threshold(d, 4.0), constants.spread(d), least, branch))


def flood(cells, reach, least):
    left, out = set(cells), []
    while left:
        todo, comp = [left.pop()], []
        while todo:
            k, m = todo.pop()
            comp.append((k, m))
            near = {(a, b) for a in range(k - reach[0], k + reach[0] + 1) for b in range(m - reach[1], m + reach[1] + 1)} & left
            left -= near
            todo += near
        ks, ms = zip(*comp)
        if max(ks) - min(ks) + 1 >= least[0] and max(ms) - min(ms) + 1 >= least[1]:
            out.append(sorted(comp))
    return {c: i for i, comp in enumerate(sorted(out), 1) for c in comp}


@pytest.mark.parametrize("tile", [4096, 7, 3])
def test_labels(spark, tile):
    cells = sorted({(int(k), int(m)) for k, m in zip(RNG.integers(0, 12, 150), RNG.integers(0, 40, 150))})
    df = spark.createDataFrame([("a", k, m) for k, m in cells], "tr string, k long, m long")
    got = {(r.k, r.m): r.cluster_id for r in label.label(df, ["tr"], (1, 2), (2, 2), tile=tile).collect()}
    assert got == flood(cells, (1, 2), (2, 2))


def test_labels_votes_and_octaves(spark):
    rows = [("a", 0, 4, 4), ("a", 1, 4, 5), ("a", 0, 9, 9)]
    df = spark.createDataFrame(rows, "tr string, c long, k long, m long")
    got = label.label(df, ["tr"], (1, 1), (1, 1), "c", 1, 2).collect()
    assert {(r.c, r.k, r.m, r.cluster_id) for r in got} == {(0, 4, 4, 1), (1, 4, 5, 1)}
    wide = label.label(df.drop("c"), ["tr"], (1, 5), (0, 1), octaves=1.5).collect()
    assert len({r.cluster_id for r in wide}) == 1


def test_intervals(spark):
    flags = spark.createDataFrame([("a", n) for n in (1, 2, 3, 6, 7, 20)], "tr string, n long")
    runs = intervals.islands(flags, ["tr"])
    assert sorted((r.start, r.end) for r in runs.collect()) == [(1, 3), (6, 7), (20, 20)]
    one = intervals.merge(runs, ["tr"], 4, 0).collect()
    assert sorted((r.interval_id, r.start, r.end) for r in one) == [(0, 1, 7), (1, 20, 20)]
    assert [(r.start, r.end) for r in intervals.merge(runs, ["tr"], 4, 1).collect()] == [(1, 7)]
    curve = spark.createDataFrame([("a", n, float(v)) for n, v in enumerate([0, 5, 5, 1, 0, 0, 2, 3])], "tr string, n long, v double")
    best = intervals.peaks(intervals.merge(runs.where("end < 10"), ["tr"], 0), curve, ["tr"], "v").collect()
    assert sorted((r.n_peak, r.peak) for r in best) == [(1, 5.0), (7, 3.0)]


def test_moving_average(spark):
    x = RNG.standard_normal(60)
    got = intervals.sta_lta(long(spark, {"a": x}), ["tr"], 10, 3).toPandas().sort_values("n")
    y = np.pad(x, (9, 2), mode="reflect") ** 2
    want = [y[i + 9 : i + 12].sum() / (y[i : i + 10].sum() + 1e-16) * 10 / 3 for i in range(60)]
    assert np.allclose(got.ratio, want)


def test_nearest_interval(spark):
    rng = np.random.default_rng(2)
    edges = np.sort(rng.random(20) * 100).reshape(-1, 2)
    spans = spark.createDataFrame([("a", i, float(s), float(e)) for i, (s, e) in enumerate(edges)], "tr string, interval_id long, t_start double, t_end double")
    centre = [float(c) for c in rng.random(60) * 120 - 10]
    items = spark.createDataFrame([("a", i, c) for i, c in enumerate(centre)] + [("b", 99, 1.0)], "tr string, item long, c double")
    got = {r["item"]: r.interval_id for r in intervals.assign(items, spans, ["tr"], F.col("c")).collect()}
    far = [[max(s - c, c - e, 0.0) for s, e in edges] for c in centre]
    assert got == {i: int(np.argmin(f)) for i, f in enumerate(far)}


def test_hulls_alignment_and_deviations(spark):
    rows = [("a", 1, 3), ("a", 1, 6), ("a", 2, 7), ("a", 2, 9), ("a", 3, 20), ("a", 3, 18)]
    got = intervals.hulls(spark.createDataFrame(rows, "tr string, cluster_id long, m long"), ["tr"]).collect()
    assert sorted((r.start, r.end) for r in got) == [(3, 9), (18, 20)]
    padded, reference = [5.0, None, 1.0, 3.0, None], [10.0, 30.0, 20.0]
    left = spark.createDataFrame([("a", i, v) for i, v in enumerate(padded)], "tr string, i long, v double")
    right = spark.createDataFrame([("a", j, v) for j, v in enumerate(reference)], "tr string, j long, v double")
    assert {r.i: r["index"] for r in match.align(left, right, ["tr"], "v").collect()} == {0: 1, 1: -1, 2: 0, 3: 2, 4: -1}
    eta = noise.to_sigma(spark.createDataFrame([("a", k, 6.0) for k in range(3)], "tr string, k long, eta double"), 3, 4.0).collect()
    assert {r.k: r.sigma for r in eta} == pytest.approx({0: 6 / constants.threshold(1, 4.0), 1: 6 / constants.threshold(2, 4.0), 2: 6 / constants.threshold(1, 4.0)})
    assert constants.ratio_of(2, 4.0) == pytest.approx(constants.threshold(2, 4.0) / constants.spread(2)) and constants.group_hertz([(1, 4)], 0.5) == [(0.5, 2.0)]


@pytest.mark.parametrize("order,octaves", [(1, False), (2, False), (3, True)])
def test_polynomial(spark, order, octaves):
    rng = np.random.default_rng(4)
    rows = [("a", c, int(k), int(m), float(a)) for c in (1, 2) for k, m, a in zip(rng.integers(0, 12, 30), rng.integers(5 * c, 30, 30), rng.random(30) + 0.1)] + [("a", 3, 4, 7, 1.0), ("a", 3, 5, 7, 2.0)]
    got = {r.cluster_id: r for r in features.polynomial(spark.createDataFrame(rows, "tr string, cluster_id long, k long, m long, amp double"), ["tr"], 0.5, 0.25, order, octaves=octaves).collect()}
    for c in (1, 2):
        k, m, a = (np.array([r[i] for r in rows if r[1] == c], float) for i in (2, 3, 4))
        f = np.log2(np.where(k == 0, 1e-3, k * 0.25)) if octaves else k * 0.25
        want = np.polynomial.Polynomial.fit((m - m.min()) * 0.5, f, order, w=a).coef
        assert [got[c][f"c{j}"] for j in range(order + 1)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
    assert got[3].c0 is None


def pair_loop(a, b, reach):
    d = np.abs(np.subtract.outer(a, b))
    d[d > reach] = np.inf
    out = set()
    for m, flip in ((d, False), (d.T, True)):
        near = [int(np.argmin(m[:, j])) if np.isfinite(m[:, j]).any() else -1 for j in range(m.shape[1])]
        for i in range(m.shape[0]):
            js = [j for j in range(m.shape[1]) if near[j] == i]
            if js:
                j = min(js, key=lambda j: m[i, j])
                out.add((j, i) if flip else (i, j))
    return out


def test_matching(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        a, b = np.sort(rng.random(12) * 30), np.sort(rng.random(15) * 30)
        left = match.numbered(spark.createDataFrame([("x", float(t)) for t in a], "tr string, t double"), ["tr"], "i")
        right = match.numbered(spark.createDataFrame([("x", float(t)) for t in b], "tr string, t double"), ["tr"], "j")
        got = {(r.i - 1, r.j - 1) for r in match.pair(match.near(left, right, ["tr"], 2.5), ["tr"]).collect()}
        assert got == pair_loop(a, b, 2.5)
        full = match.match(left, right, ["tr"], 2.5)
        c = score.rates(score.picks(full, ["tr"])).first()
        assert c.tp == len(got) and c.fn == 12 - len({i for i, _ in got}) and c.fp == 15 - len({j for _, j in got})


def test_paired_has_what_all_near_pairs_give(spark):
    rng = np.random.default_rng(5)
    sides, want, mutual = ([], []), set(), set()
    for tr in range(12):
        times = [np.round(rng.random(n) * 40 - 20, tr % 3).tolist() for n in rng.integers(0, 25, 2)]
        for side, ts in zip(sides, times):
            side += [(f"t{tr}", n, t) for n, t in zip(rng.permutation(len(ts)).tolist(), ts)] + [(f"t{tr}", 90, None), (f"t{tr}", 91, float("nan")), (None, tr, 0.0)]
        a, b = ([t for _, _, t in sorted(r for r in side if r[0] == f"t{tr}" and r[1] < 90)] for side in sides)
        want |= {(f"t{tr}", i, j) for i, j in pair_loop(np.array(a), np.array(b), 2.0)} if a and b else set()
        near = lambda x, ys: min(((abs(x - y), n) for n, y in enumerate(ys) if abs(x - y) <= 2.0), default=(0, -1))[1]
        mutual |= {(f"t{tr}", i, near(t, b)) for i, t in enumerate(a) if near(t, b) >= 0 and near(b[near(t, b)], a) == i}
    left, right = (spark.createDataFrame(side, f"tr string, {name} long, t double") for side, name in zip(sides, "ij"))
    for strict, expected in ((False, want), (True, mutual)):
        got = match.paired(left, right, ["tr"], 2.0, strict).collect()
        assert sorted((r.tr, r.i, r.j) for r in got) == sorted(expected) and all(r.d == abs(r.ta - r.tb) for r in got)


def test_numbers_go_on_from_bucket_to_bucket(spark):
    rng = np.random.default_rng(6)
    rows = [(tr, n, t) for tr in ("a", "b", None) for n, t in enumerate([*(rng.random(60) * 90000 - 40000).tolist(), 7.0, 7.0, None, None, float("nan"), float("inf")])]
    got = match.in_order(spark.createDataFrame(rows, "tr string, n long, t double"), ["tr"], "i", "t", "n").collect()
    last = lambda t: (t is None, t is not None and np.isnan(t), t if t is not None and not np.isnan(t) else 0.0)
    for tr in ("a", "b", None):
        want = {n: i for i, (_, n, _) in enumerate(sorted((r for r in rows if r[0] == tr), key=lambda r: (*last(r[2]), r[1])), 1)}
        assert {r.n: r.i for r in got if r.tr == tr} == want
    assert len(got) == len(rows) and set(got[0].asDict()) == {"tr", "n", "t", "i"}
    numbers = match.numbered(spark.createDataFrame([("a", None), ("a", 2.0), ("a", 1.0)], "tr string, t double"), ["tr"], "i").collect()
    assert {r.t: r.i for r in numbers} == {1.0: 1, 2.0: 2, None: 3}


def test_repair_streams_by_trace(spark):
    rows = [(tr, i, float(i), 2.0 * i + (40 if i % 50 == 7 else 0)) for tr in ("a", None, "b") for i in range(120)] + [("c", 0, 1.0, None), ("c", 1, None, 2.0)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        df = match.repair(spark.createDataFrame(rows, "tr string, i long, strong double, weak double"), ["tr"], 1.5)
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {(r.tr, r.i) for r in got if r.odd} == {(tr, i) for tr in ("a", None, "b") for i in (7, 57, 107)} and len(got) == len(rows)
    assert sorted(r.weak for r in got if r.tr == "a" and r.odd) == pytest.approx([14.0, 114.0, 214.0])
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_association_and_repair(spark):
    rows = [("e", s, 10.0 * e + 0.1 * s) for e in range(3) for s in range(4) if (e, s) != (2, 1) and not (e == 1 and s > 0)]
    picks = spark.createDataFrame(rows, "tr string, station int, t double")
    got = match.associate(picks, ["tr"], {s: float(s) for s in range(4)}, 1.0, 0.6).collect()
    assert {(r.event, r.station) for r in got} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 2), (2, 3)}
    line = [("a", i, float(i), 2.0 * i + (40 if i == 5 else 0)) for i in range(10)]
    fixed = match.repair(spark.createDataFrame(line, "tr string, i long, strong double, weak double"), ["tr"], 1.5).collect()
    assert [r.i for r in fixed if r.odd] == [5] and {r.i: r.weak for r in fixed}[5] == pytest.approx(10.0)


def test_association_plan_does_not_grow(spark):
    rows = [("e", s, 100.0 * e + 0.1 * s) for e in range(3) for s in range(12)]
    picks = spark.createDataFrame(rows, "tr string, station int, t double")
    out = match.associate(picks, ["tr"], {s: float(s) for s in range(12)}, 1.0, 0.6)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") < 20
    assert {(r.event, r.station, round(r.t, 6)) for r in out.collect()} == {(e + 1, s, round(100.0 * e + 0.1 * s, 6)) for _, s, t in rows for e in range(3)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_bases(y):
    start, least = phases.bases(np.array(y, float))
    for i in range(len(y)):
        a = max([j for j in range(i) if y[j] > y[i]], default=-1) + 1
        assert (start[i], least[i]) == (a, min(y[a : i + 1]))


def test_curve_peaks(spark):
    y = np.round(RNG.standard_normal(80).cumsum(), 2)
    got = {r.n: (r.prominence, r.width) for r in phases.peaks(long(spark, {"a": y}), ["tr"], "x").collect()}
    want = {}
    for i in range(1, 79):
        if y[i] > y[i - 1] and y[i] >= y[i + 1]:
            a = max([j for j in range(i) if y[j] > y[i]], default=-1) + 1
            b = min([j for j in range(i + 1, 80) if y[j] > y[i]], default=80)
            p = y[i] - max(y[a : i + 1].min(), y[i:b].min())
            low = [j for j in range(80) if y[j] < y[i] - p / 2]
            want[i] = (p, min([j for j in low if j > i], default=b) - max([j for j in low if j < i], default=a - 1) - 1)
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_coloured_noise(spark):
    flat = long(spark, {"a": np.zeros(4096), "b": np.zeros(4096)})
    out = score.augment(flat, ["tr"], [2.0], [0.0, 1.0, 2.0], 2).toPandas()
    again = score.augment(flat.repartition(3), ["tr"], [2.0], [0.0, 1.0, 2.0], 2).toPandas()
    by = ["tr", "level", "colour", "repeat", "n"]
    assert np.array_equal(out.sort_values(by).x, again.sort_values(by).x) and len(out) == 2 * 3 * 2 * 4096
    for (_, _, colour, _), part in out.groupby(by[:-1]):
        power, f = np.abs(np.fft.rfft(part.sort_values("n").x))[1:] ** 2, np.arange(1, 2049)
        slope = np.polyfit(np.log(f), np.log(power), 1)[0]
        assert part.x.std() == pytest.approx(2.0, rel=0.05) and slope == pytest.approx(-colour, abs=0.15)
    gone = score.augment(flat.withColumn("x", F.lit(1.0)), ["tr"], [0.0], repeats=40, dropout=0.5).groupBy("tr", "repeat").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()
    assert {(r.a, r.b) for r in gone} == {(0.0, 0.0), (1.0, 1.0)}


def test_measures_by_name(spark):
    a, b = long(spark, {"a": [3.0, 0.0, 4.0]}), long(spark, {"a": [3.0, 5.0, 4.0]})
    assert score.measure("l1", ["tr"])(a, b).first().error == 5.0 and score.measure("rel l2", ["tr"])(a, b).first().error == pytest.approx(1.0)
    picks = lambda ts: spark.createDataFrame([("a", t) for t in ts], "tr string, t double")
    assert score.measure("picks2.5 f0.5", ["tr"])(picks([1.0, 9.0]), picks([2.0, 30.0])).select("tp", "fp", "fn").first() == (1, 1, 1)
    flag = lambda vs, name="flag": spark.createDataFrame([("a", n, v) for n, v in enumerate(vs)], f"tr string, n long, {name} {'double' if name == 'chance' else 'boolean'}")
    assert score.measure("f1", ["tr"])(flag([True, False, True]), flag([True, True, False])).first().f == pytest.approx(0.5, abs=1e-6)
    assert score.measure("bce", ["tr"])(flag([True, False]), flag([0.5, 0.5], "chance")).first().cross_entropy == pytest.approx(np.log(2))
    got = score.evaluate([(b, a, {"case": 1})], lambda x: x.withColumn("x", F.col("x") - 1), {"l1": score.measure("l1", ["tr"])})
    assert got[0]["case"] == 1 and got[0]["l1"].first().error == 6.0


def brute_basins(value, place, reach, least):
    """Peaks' basins by lowering the level one point at a time over plain sets."""
    order = sorted(range(len(value)), key=lambda i: (-value[i], tuple(place[i])))
    basins = []
    for i in order:
        if value[i] <= 0:
            continue
        near = [b for b in basins if any(all(abs(p - q) <= r for p, q, r in zip(place[i], place[j], reach)) for j in b["in"])]
        if not near:
            basins.append({"top": i, "in": {i}, "names": {i: i}})
            continue
        next_to = [j for b in near for j in b["in"] if all(abs(p - q) <= r for p, q, r in zip(place[i], place[j], reach))]
        home = min(next_to, key=lambda j: (-value[j], j))
        whole = {"top": None, "in": {i}, "names": {}}
        tops = sorted((b["top"] for b in near), key=lambda t: (-value[t], t))
        for b in near:
            whole["in"] |= b["in"]
            whole["names"] |= b["names"]
        whole["names"][i] = whole["names"][home]
        for t in tops[1:]:
            if value[t] - value[i] < least:
                whole["names"] = {j: tops[0] if n == t else n for j, n in whole["names"].items()}
        whole["top"] = tops[0]
        basins = [b for b in basins if b not in near] + [whole]
    return {j: n for b in basins for j, n in b["names"].items()}


def test_persistence_without_merging():
    rng = np.random.default_rng(11)
    for _ in range(5):
        place = np.argwhere(rng.random((7, 8)) < 0.8)
        value = rng.random(len(place)).round(3) + 0.01
        basin, prominence = phases.persistence(value, place, (1, 1), 0.0)
        want = brute_basins(value.tolist(), place.tolist(), (1, 1), 0.0)
        assert basin.tolist() == [want[i] for i in range(len(value))]
        assert prominence[int(np.argmax(value))] == pytest.approx(value.max())


def test_scores(spark):
    assert score.parse_metric("rel l2") == ("lp", {"relative": True, "p": 2.0})
    assert score.parse_metric("picks2.5 f0.5") == ("picks", {"reach": 2.5, "beta": 0.5})
    with pytest.raises(ValueError):
        score.parse_metric("nothing")
    rows = spark.createDataFrame([("a", n, t, g) for n, (t, g) in enumerate(zip([0, 0, 1, 1, 0, 0, 0, 1, 1, 0], [0, 1, 1, 1, 0, 1, 0, 0, 0, 0]))], "tr string, n long, truth int, guess int")
    got = score.tolerant(rows.withColumns({"truth": F.col("truth") == 1, "guess": F.col("guess") == 1}), ["tr"], 0.5, 2).first()
    assert (got.tp, got.fn, got.fp) == (1, 1, 1)


def test_phases(spark):
    t = np.arange(60)
    y = np.exp(-((t - 15) ** 2) / 30) + 0.8 * np.exp(-((t - 42) ** 2) / 30)
    basin, prominence = phases.persistence(y, t[:, None], (1,), 0.3)
    assert sorted(np.unique(basin)) == [15, 42] and prominence[15] == pytest.approx(1.0)
    cells = spark.createDataFrame([("a", 1, 3, int(m), float(v)) for m, v in zip(t, y)], "tr string, cluster_id long, k long, m long, amp double")
    for out in (phases.split_spline(cells, ["tr"], least=0.3), phases.split_persistent(cells, ["tr"], least=0.3)):
        of = {r.m: r.phase for r in out.collect()}
        assert of[15] == 0 and of[42] == 1 and set(of.values()) == {0, 1}
    assert np.allclose(phases.natural_spline(y)[:, 3], y[:-1])


def test_features(spark):
    rows = [("a", 1, k, m, 1.0 + k * m, 2.0) for k in (2, 3) for m in (4, 5, 6)]
    cells = spark.createDataFrame(rows, "tr string, cluster_id long, k long, m long, amp double, snr double")
    c = features.catalog(cells, ["tr"], features.extent(1.0, 1.0)).first()
    assert (c.time_peak, c.frequency_peak, c.energy_peak, c.snr_sum) == (6.0, 3.0, 19.0, 12.0)
    assert set(features.with_units(features.catalog(cells, ["tr"], features.extent(1.0, 1.0))).columns) >= {"time_peak_sec", "frequency_peak_hz"}
    w = np.array([r[4] for r in rows])
    f = np.array([r[2] for r in rows])
    m = features.moments(cells, ["tr"], 1.0, 1.0).first()
    mean = (w * f).sum() / w.sum()
    assert m.m10 == pytest.approx(mean) and m.m20 == pytest.approx((w * (f - mean) ** 2).sum() / w.sum())


def bursts(rng):
    """Three components of six stations with tone bursts at 7 and 14 seconds."""
    n = np.arange(4000) * 0.005
    for c in range(3):
        for s in range(6):
            x = 0.1 * rng.standard_normal(len(n)) + 0.1 * np.sin(2 * np.pi * 50 * n)
            for start in (7.0, 14.0):
                u = (n - start - 0.02 * s) / 0.6
                x += np.where((u >= 0) & (u < 1), np.sin(np.pi * u) ** 2 * np.sin(2 * np.pi * 10 * n), 0)
            yield c, s, x


def test_planted_bursts(spark):
    import pandas as pd

    pdf = pd.concat([pd.DataFrame({"component": c, "station": s, "n": np.arange(4000), "x": x}) for c, s, x in bursts(np.random.default_rng(3)) if s < 2])
    df = spark.createDataFrame(pdf).cache()
    p = Spectral(**(PRESETS["components"].as_dict() | {"band_hz": (2.0, 30.0), "size_hz": 4.0}))
    found = detectors.detect(df, ["component", "station"], p, 4000, component="component")["intervals"].collect()
    for s in range(2):
        spans = sorted((r.t_start, r.t_end) for r in found if r.station == s)
        assert any(a < 7.3 < b for a, b in spans) and any(a < 14.3 < b for a, b in spans)
        assert sum(b - a for a, b in spans) < 8
    back = denoisers.denoise(df, ["component", "station"], p, 4000, component="component").toPandas()
    one = back[(back.component == 0) & (back.station == 0)].sort_values("n").x.to_numpy()
    assert np.abs(one[200:1000]).max() < 0.05 and np.abs(one[1400:1520]).max() > 0.7


def test_scale_invariance(spark):
    x = RNG.standard_normal(720) * (1 + 4 * (np.arange(720) % 240 < 20))
    p = Spectral(dt=1.0, window_s=24.0, nfft=32, rho=4.0)
    masks = []
    for scale in (1.0, 64.0):
        cells = detectors.cells_of(long(spark, {"a": x * scale}), ["tr"], p, 720)
        masks.append({(r.k, r.m) for r in cells.where("keep").select("k", "m").collect()})
    assert masks[0] == masks[1] and masks[0]


def test_replaced_checkpoints_go(spark):
    import os

    from wavetable.session import stable

    where = lambda df: df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    a = stable(spark.range(100).repartition(3))
    old = where(a)
    assert os.path.isdir(old)
    b = stable(a.withColumn("x", F.col("id") * 2), a)
    assert not os.path.exists(old) and os.path.isdir(where(b)) and b.agg(F.sum("x")).first()[0] == 9900


def test_files(spark, tmp_path):
    df = long(spark, {"a": [3.0, 1.0, 2.0]})
    assert files.pack(df, ["tr"]).first().x == [3.0, 1.0, 2.0]
    assert files.unpack(files.pack(df, ["tr"]), ["tr"]).count() == 3
    files.save({"series": df}, str(tmp_path), {"rho": 4})
    got, params = files.load(spark, str(tmp_path), ["series"])
    assert got["series"].count() == 3 and params == {"rho": 4}
    assert "source_file" in files.read_any(spark, f"{tmp_path}/series", "parquet").columns
    with pytest.raises(ValueError):
        files.read_any(spark, "x.exe")
    with pytest.raises(ValueError):
        Spectral(dt=1.0, window_s=0)
    assert Spectral.from_dict(PRESETS["denoise"].as_dict()) == PRESETS["denoise"]


def test_detector_on_files(spark, tmp_path):
    from wavetable.sources import synthetic

    df = synthetic.bursts(spark, 1, 1, 3000).withColumn("delta", F.lit(0.005)).drop("component").cache()
    p = Spectral(**(PRESETS["components"].as_dict() | {"band_hz": (2.0, 30.0), "size_hz": 4.0}))
    for name in ("one.parquet", "two.parquet"):
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    used = detectors.detect_on_files(spark, f"{tmp_path}/in/*", ["station"], p, 3000, str(tmp_path / "out"), kind="parquet")
    got, params = files.load(spark, str(tmp_path / "out"), ["catalog", "intervals"])
    whole = detectors.detect(df.select("station", "n", "x"), ["station"], p, 3000)["catalog"].collect()
    per = got["catalog"].groupBy("source_file").count().collect()
    assert used == p == Spectral.from_dict(params) and len(per) == 2 and {r["count"] for r in per} == {len(whole)} and whole
    with pytest.raises(ValueError):
        files.one_step(df.withColumn("delta", F.col("n") * 1.0))


def test_streaming(spark, sf, tmp_path):
    from wavetable.sources import traces
    from wavetable.streaming import streams

    events = traces.table(spark, sf, "events")
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in"))
    q = streams.hourly_sums(stream).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.tr, r.window.start): round(r.x, 4) for r in spark.table("sums").collect()}
    want = {(r.event_type, r.window.start): round(r.x, 4) for r in stamped.groupBy("event_type", F.window("ts", "1 hour")).agg(F.sum("value").alias("x")).collect()}
    assert got == want


def test_streaming_frames_and_sessions(spark, tmp_path):
    from wavetable.streaming import streams

    rows = [("a", 10 * i, float(i % 4)) for i in range(30)] + [("b", s, 1.0) for s in (0, 20, 200, 215, 900)]
    df = spark.createDataFrame(rows, "tr string, s long, x double").select("tr", F.timestamp_seconds("s").alias("ts"), "x")
    df.write.parquet(str(tmp_path / "in"))
    for name, f in (("frames", lambda x: streams.frame_energy(x, ["tr"], "60 seconds", "30 seconds", "1 hour")), ("runs", lambda x: streams.sessions(x, ["tr"], "30 seconds", "1 hour"))):
        q = f(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    frames = {(r.tr, r.window.start.timestamp()): r.energy for r in spark.table("frames").collect()}
    want = {}
    for tr, s, x in rows:
        for start in range(s // 30 * 30 - 30, s // 30 * 30 + 1, 30):
            want[tr, float(start)] = want.get((tr, float(start)), 0) + x * x
    assert frames == want
    assert sorted((r.tr, r.session_window.start.timestamp(), r.n) for r in spark.table("runs").collect()) == [("a", 0.0, 30), ("b", 0.0, 2), ("b", 200.0, 2), ("b", 900.0, 1)]


def test_synthetic_and_export(spark, tmp_path):
    from wavetable.sources import synthetic

    df = synthetic.bursts(spark, 1, 2, 3000)
    assert df.count() == 6000
    loud = df.where("n between 1420 and 1500").agg(F.max("x")).first()[0]
    assert loud > 0.7
    spans = spark.createDataFrame([(0, 1, 0, 7.0, 7.5)], "component int, station int, interval_id long, t_start double, t_end double")
    cut = intervals.cut_out(df, spans, ["component", "station"], 0.005)
    assert cut.count() == 101
    files.export_events(cut, ["component", "station"], str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("interval_id = 0").count() == 101


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=25, unique=True))
def test_neighbours(cells):
    place = np.array(cells)
    got = {tuple(sorted(p)) for p in label.neighbours(place, (1, 2)).tolist()}
    want = {(i, j) for i in range(len(cells)) for j in range(i + 1, len(cells)) if abs(cells[i][0] - cells[j][0]) <= 1 and abs(cells[i][1] - cells[j][1]) <= 2}
    assert got == want
