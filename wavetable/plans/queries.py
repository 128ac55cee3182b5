"""The registry: every operator as a query over the driver's tables.

Traces are hourly sums of the event stream; time is in hours, a frame step is
six of them, a bin one thirty-second of a cycle an hour.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetable.functions.constants import bin_groups
from wavetable.operators import features, intervals, label, match, noise, phases, score, transform
from wavetable.params import Spectral
from wavetable.plans import denoise as denoisers
from wavetable.plans import detect as detectors
from wavetable.plans.oracle import CATALOG_COLUMNS, ORACLE
from wavetable.session import stable
from wavetable.sources import files
from wavetable.sources import traces as src

P = Spectral(dt=1.0, window_s=24.0, nfft=32, rho=4.0, size_s=12.0, size_hz=2 / 32)
N, FRAMES, STEP, DF, TR = src.HOURS, 120, 6.0, 1 / 32, ["tr"]
COMP = ["component", "station"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: r(F.col(c), digits) for c in columns})


def _tf(spark, d):
    return transform.stft(src.hourly(spark, d), TR, P.window, P.hop, P.fft)


def _sigma(spark, d, rho, branch, groups=None):
    blocks = noise.in_blocks(_tf(spark, d), groups or bin_groups(P.bins, 1), P.frame, FRAMES)
    return rounded(noise.level(blocks, TR, rho, 30, branch).select("tr", F.col("g").cast("long"), "n", "sigma"), 6, "sigma")


def _cells(spark, d):
    return detectors.cells_of(src.hourly(spark, d), TR, P, N)


def _cells_multi(spark, d):
    return detectors.cells_of(src.multi(spark, d), COMP, P, N)


def _labels(cells):
    return label.label(cells.where("keep").select("tr", "k", "m"), TR, (1, 1), (2, 2))


def _inside(spark, d):
    kept = stable(_cells(spark, d).where("keep"))
    return kept.join(_labels(kept), ["tr", "k", "m"])


def _catalog(spark, d):
    return stable(features.catalog(_inside(spark, d), TR, features.extent(STEP, DF)))


def _spans(catalog):
    return intervals.union_on_grid(catalog.select("tr", F.col("time_start").alias("t_start"), F.col("time_end").alias("t_end")), TR, STEP, STEP)


def _strong(c):
    return (F.col("snr_peak") > 3) & (F.col("time_end") - F.col("time_start") > 12)


@query
def series_hourly(spark, d):
    return src.hourly(spark, d)


@query
def series_daily(spark, d):
    return src.daily(spark, d)


@query
def sta_lta_ratio(spark, d):
    return rounded(intervals.sta_lta(src.hourly(spark, d), TR, 48, 6), 6, "ratio")


def _sta(spark, d):
    return detectors.detect_sta_lta(src.hourly(spark, d), TR, 48, 6, 1.25, 3)


@query
def sta_lta_intervals(spark, d):
    return _sta(spark, d)["intervals"].withColumnsRenamed({"start": "n_start", "end": "n_end"})


@query
def sta_lta_peaks(spark, d):
    return rounded(_sta(spark, d)["peaks"].withColumnsRenamed({"start": "n_start", "end": "n_end"}), 6, "peak")


@query
def curve_component_max(spark, d):
    return rounded(detectors.detect_sta_lta(src.multi(spark, d), COMP, 48, 6, 1.25, 3, over=["station"])["curve"], 6, "ratio")


@query
def intervals_raster(spark, d):
    return intervals.raster(_sta(spark, d)["intervals"], TR)


@query
def stft_amplitude(spark, d):
    return _tf(spark, d).select("tr", "k", "m", r("amp").alias("amp"))


@query
def stft_band_power(spark, d):
    return _tf(spark, d).where(F.col("k").between(2, 8)).groupBy("tr", "m").agg(r(F.sum(F.col("amp") ** 2), 4).alias("power"))


@query
def psd_noise_model(spark, d):
    return rounded(noise.power_model(_tf(spark, d).where("m < 60"), TR), 3, "mean", "std")


def _power(spark, d):
    return detectors.detect_power(src.hourly(spark, d), TR, P, N, F.col("m") < 60, 0.5, 2)


@query
def psd_zscore_trim(spark, d):
    return _power(spark, d)["scores"].where("z > 0").select("tr", "k", "m", r("z").alias("z"))


@query
def psd_likelihood(spark, d):
    return rounded(_power(spark, d)["curve"], 6, "likelihood")


@query
def psd_intervals(spark, d):
    return rounded(_power(spark, d)["peaks"].withColumnsRenamed({"start": "m_start", "end": "m_end"}), 6, "peak")


@query
def noise_sigma_max(spark, d):
    return _sigma(spark, d, 4.0, "high")


@query
def noise_sigma_low_snr(spark, d):
    return _sigma(spark, d, 3.0, "low")


@query
def noise_sigma_original(spark, d):
    return _sigma(spark, d, 4.0, "original")


@query
def noise_sigma_grouped(spark, d):
    return _sigma(spark, d, 4.0, "high", bin_groups(P.bins, 5))


@query
def trim_mask(spark, d):
    return _cells(spark, d).where("keep").select("tr", "k", "m")


@query
def snr_cells(spark, d):
    return _cells(spark, d).select("tr", "k", "m", r("snr").alias("snr"), "keep")


@query
def snr_cells_auto(spark, d):
    cells = detectors.cells_of(src.hourly(spark, d), TR, replace(P, rho=None), N)
    return cells.select("tr", "k", "m", r("snr").alias("snr"), "keep")


@query
def mask_any_component(spark, d):
    return noise.over_components(_cells_multi(spark, d), ["station", "k", "m"], "keep")


@query
def label_cells(spark, d):
    return _labels(_cells(spark, d))


@query
def label_cells_multitrace(spark, d):
    cells = _cells_multi(spark, d).where("keep")
    order = src.table(spark, d, "events").select(F.col("event_type").alias("station")).distinct().withColumn("c", (F.row_number().over(Window.orderBy("station")) - 1).cast("long"))
    mask = cells.join(order, "station").select("component", "c", "k", "m")
    return label.label(mask, ["component"], (1, 1), (2, 2), "c", 1, 2)


@query
def cluster_extent_filter(spark, d):
    sizes = _labels(_cells(spark, d)).groupBy("tr", "cluster_id").agg(F.min("k").alias("k_lo"), F.max("k").alias("k_hi"), F.min("m").alias("m_lo"), F.max("m").alias("m_hi"), F.count("*").alias("cells"))
    return sizes.where((F.col("k_hi") - F.col("k_lo") >= 2) & (F.col("m_hi") - F.col("m_lo") >= 2))


@query
def catalog_bbox(spark, d):
    return rounded(_catalog(spark, d), 4, *CATALOG_COLUMNS)


@query
def catalog_energy_stats(spark, d):
    out = features.catalog(_inside(spark, d), TR, features.energy_statistics())
    return rounded(rounded(out, 4, "e_min", "e_max", "e_mean", "e_std", "e_skew", "e_kurtosis"), 6, "e_flatness", "e_entropy")


@query
def catalog_moments(spark, d):
    out = features.shape(features.moments(_inside(spark, d), TR, STEP, DF))
    names = ["m00", "m10", "m01", "m20", "m11", "m02", "m30", "m03", "m40", "m04"]
    return out.select("tr", "cluster_id", *(r(c, 4).alias(c) for c in names), r("f_std").alias("f_std"), r("t_std").alias("t_std"), r("t_kurtosis", 4).alias("t_kurtosis"))


@query
def catalog_peak_arrival(spark, d):
    return rounded(features.arrival(_inside(spark, d), TR, STEP), 6, "arrival")


@query
def catalog_line(spark, d):
    out = features.polynomial(_inside(spark, d), TR, STEP, DF)
    return rounded(out, 6, "c0", "c1")


@query
def catalog_parabola(spark, d):
    out = features.polynomial(_inside(spark, d).where("k > 0"), TR, STEP, DF, 2, octaves=True)
    return rounded(out, 4, "c0", "c1", "c2")


@query
def catalog_start(spark, d):
    return rounded(features.arrival(_inside(spark, d), TR, STEP, mode="cluster_start"), 6, "arrival")


@query
def component_energy(spark, d):
    cells = transform.stft(src.multi(spark, d), COMP, P.window, P.hop, P.fft)
    return rounded(features.combine_components(cells, ["station"], "amp"), 4, "amp")


@query
def noise_sigma_robust(spark, d):
    return _sigma(spark, d, 4.0, "robust")


@query
def noise_threshold_sigma(spark, d):
    blocks = noise.in_blocks(_tf(spark, d), bin_groups(P.bins, 1), P.frame, FRAMES)
    eta = noise.level(blocks, TR, 4.0, 30, "high").select("tr", F.col("g").cast("long").alias("k"), (F.col("sigma") * F.col("xi")).alias("eta"))
    return rounded(noise.to_sigma(eta, P.bins, 4.0), 6, "eta", "sigma")


@query
def label_hulls(spark, d):
    return intervals.hulls(_labels(_cells(spark, d)), TR).withColumnsRenamed({"start": "m_start", "end": "m_end"})


@query
def cluster_periods(spark, d):
    inside = stable(_inside(spark, d))
    of = lambda how: phases.period(inside, TR, DF, STEP, how=how).withColumnRenamed("period", how)
    return rounded(of("centroid").join(of("peak"), [*TR, "cluster_id"]).join(of("time"), [*TR, "cluster_id"]), 4, "centroid", "peak", "time")


@query
def cluster_projection(spark, d):
    return rounded(phases.project(_inside(spark, d), TR), 6, "curve")


@query
def cells_smoothed(spark, d):
    return rounded(phases.smooth(_inside(spark, d).select("tr", "cluster_id", "k", "m", "amp"), TR, (1, 1)), 4, "amp")


@query
def series_chunks(spark, d):
    return rounded(files.chunked(src.hourly(spark, d), 100).groupBy("tr", "chunk_id").agg(F.count("*").alias("samples"), F.sum("x").alias("total")), 4, "total")


@query
def detrended(spark, d):
    return rounded(transform.detrend(src.hourly(spark, d), TR), 4, "x")


@query
def envelope_curve(spark, d):
    return rounded(transform.envelope(src.hourly(spark, d), TR), 4, "x")


@query
def catalog_filtered(spark, d):
    catalog = _catalog(spark, d)
    return label.drop_rejected(_labels(_cells(spark, d)), catalog.where(_strong(catalog)), TR).select("tr", "k", "m", "cluster_id")


@query
def catalog_outer_merge(spark, d):
    c = _catalog(spark, d)
    old, new = c.where("snr_peak > 3").select("tr", "cluster_id", "snr_peak"), c.where("time_end - time_start > 12").select("tr", "cluster_id", "snr_peak", "energy_sum")
    return rounded(features.merge_catalogs(old, new, TR), 4, "snr_peak_old", "snr_peak_new", "energy_sum")


@query
def catalog_append(spark, d):
    c = _catalog(spark, d)
    both = features.append(c, c.where(_strong(c)), TR, 720.0, ["time_start", "time_end"])
    return rounded(both.select("tr", "cluster_id", "time_start", "time_end"), 4, "time_start", "time_end")


@query
def topk_clusters(spark, d):
    return features.best(_catalog(spark, d), TR, "energy_peak", ["cluster_id"], 3).select("tr", "cluster_id", "rank", r("energy_peak", 4).alias("energy_peak"))


def _likely(spark, d):
    return features.likelihood(_inside(spark, d), TR)


@query
def likelihood_curve(spark, d):
    return rounded(_likely(spark, d), 6, "likelihood")


@query
def intervals_islands(spark, d):
    return intervals.islands(_likely(spark, d).where("likelihood > 4"), TR, "m").withColumnsRenamed({"start": "m_start", "end": "m_end"})


@query
def intervals_merged(spark, d):
    return intervals.from_curve(_likely(spark, d), TR, "likelihood", 4, 3, at="m").withColumnsRenamed({"start": "m_start", "end": "m_end"})


@query
def catalog_intervals(spark, d):
    return rounded(_spans(_catalog(spark, d)), 4, "t_start", "t_end")


@query
def interval_top_cluster(spark, d):
    c = _catalog(spark, d)
    placed = intervals.assign(c, _spans(c), TR, (F.col("time_start") + F.col("time_end")) / 2)
    return features.best(placed, ["tr", "interval_id"], "energy_peak", ["cluster_id"]).select("tr", "interval_id", "cluster_id", r("time_peak", 4).alias("time_peak"), r("energy_peak", 4).alias("energy_peak"))


@query
def interval_overlap_window(spark, d):
    return rounded(_spans(_catalog(spark, d)).where(intervals.overlaps(F.col("t_start"), F.col("t_end"), 200.0, 400.0)), 4, "t_start", "t_end")


@query
def interval_extend_clip(spark, d):
    return rounded(intervals.extend(_spans(_catalog(spark, d)), None, 6.0, 719.0), 4, "t_start", "t_end")


@query
def interval_segments(spark, d):
    return rounded(intervals.segments(_spans(_catalog(spark, d)), STEP, STEP), 4, "t_start", "t_end")


@query
def event_cutouts(spark, d):
    return intervals.cut_out(src.hourly(spark, d), _spans(_catalog(spark, d)), TR, 1.0)


def _sides(spark, d):
    truth, guess = src.picks(spark, d, "purchase").select("tr", "t"), src.picks(spark, d, "error").select("tr", "t")
    return match.numbered(truth, TR, "i"), match.numbered(guess, TR, "j")


@query
def picks_pairs(spark, d):
    return match.paired(*_sides(spark, d), TR, 3600.0).select("tr", "i", "j", r("d").alias("d"))


@query
def picks_full_match(spark, d):
    return rounded(match.match(*_sides(spark, d), TR, 3600.0), 6, "ta", "tb").select("tr", "i", "ta", "j", "tb")


@query
def picks_scores(spark, d):
    out = score.rates(score.picks(match.match(*_sides(spark, d), TR, 3600.0), TR))
    return out.select("tr", "tp", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"))


@query
def picks_in_intervals(spark, d):
    truth, guess = _sides(spark, d)
    spans = guess.select("tr", F.col("j").alias("interval_id"), (F.col("t") - 1800).alias("t_start"), (F.col("t") + 1800).alias("t_end"))
    return score.intervals(match.first_interval(truth, spans, TR), spans, TR).select("tr", "tp", "fp", "fn")


@query
def association_votes(spark, d):
    picks = src.picks(spark, d, "purchase").select("tr", F.col("station").cast("int"), "t")
    return rounded(match.associate(picks, TR, {0: 0.0, 1: 1.0, 2: 2.0}, 7200.0, 0.5), 6, "t")


@query
def picks_aligned(spark, d):
    found = match.match(*_sides(spark, d), TR, 3600.0)
    return match.align(found.where("i is not null").groupBy("tr", "i").agg(F.min("tb").alias("t")), found.where("i is not null and j is not null").groupBy("tr", "j").agg(F.min("tb").alias("t")), TR, "t").select("tr", "i", r("t").alias("t"), "index")


@query
def picks_near_points(spark, d):
    side = lambda kind, name: src.picks(spark, d, kind).withColumn(name, F.row_number().over(Window.partitionBy("tr").orderBy("t", "station")).cast("long"))
    return rounded(match.near_vectors(side("purchase", "i"), side("error", "j"), TR, ["t", "station"], 1800.0, 2.0), 6, "d")


@query
def denoiser_scores(spark, d):
    clean = src.hourly(spark, d)
    guess = stable(denoisers.denoise_power(clean, TR, P, N, F.col("m") < 60, 1.0))
    rows = score.evaluate([(guess, clean, {})], lambda x: x, {name: score.measure(name, TR) for name in ("l2", "rel l1")})[0]
    return rounded(rows["l2"].select("tr", F.col("error").alias("l2")).join(rows["rel l1"].select("tr", F.col("error").alias("rel_l1")), TR), 4, "l2", "rel_l1")


@query
def f_beta_flags(spark, d):
    rows = src.table(spark, d, "labels").select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("guess"))
    return score.rates(score.flags(rows, [], "truth", "guess"), 0.5).select("tp", "fp", "fn", r("f").alias("f"))


@query
def cross_entropy(spark, d):
    rows = src.table(spark, d, "labels").select("quality", (F.lit(0.1) + F.lit(0.8) * (1 - F.col("toxic"))).alias("p"))
    return rounded(score.cross_entropy(rows, [], "quality", "p"), 6, "cross_entropy")


@query
def lp_error(spark, d):
    v = src.vectors(spark, d)
    other = v.select((F.col("station") - 1).alias("station"), "n", F.col("x").alias("y"))
    return rounded(score.lp_error(v.join(other, ["station", "n"]), ["label", "station"], "x", "y"), 6, "error", "accuracy")


@query
def denoised_hourly(spark, d):
    return rounded(denoisers.denoise(src.hourly(spark, d), TR, P, N), 4, "x")


@query
def augment_grid(spark, d):
    traces = src.hourly(spark, d)
    return rounded(score.scaled_grid(traces, traces.where("tr = 'error'").select("n", "x"), TR, [0.5, 2.0]), 6, "x")


@query
def denoised_power(spark, d):
    return rounded(denoisers.denoise_power(src.hourly(spark, d), TR, P, N, F.col("m") < 60, 1.0), 4, "x")


@query
def denoised_wavelet(spark, d):
    return denoisers.denoise_wavelet(src.hourly(spark, d), TR, 1.0, N, 4.0, 250)


@query
def denoised_bandpass(spark, d):
    return rounded(transform.bandpass(src.hourly(spark, d), TR, 1.0, 1 / 48, 1 / 6), 4, "x")


@query
def denoised_sparse(spark, d):
    return transform.sparse_gabor(src.hourly(spark, d), TR, 24, 6, 50.0)


@query
def cwt_amplitude(spark, d):
    return rounded(rounded(transform.cwt(src.hourly(spark, d), TR, 1.0, 4), 3, "re", "im", "amp"), 6, "freq")


@query
def envelope_peaks(spark, d):
    return detectors.pick_phases(transform.detrend(src.hourly(spark, d), TR), TR, 0.0)


@query
def decimated(spark, d):
    return rounded(transform.decimate(src.hourly(spark, d), TR, 4, 1.0), 4, "x")


@query
def phases_persistent(spark, d):
    return phases.split_persistent(_inside(spark, d), TR)


@query
def phases_spline(spark, d):
    return phases.split_spline(_inside(spark, d), TR)


@query
def coloured_noise(spark, d):
    return score.augment(src.hourly(spark, d), TR, [1.0], [0.0, 1.0])


@query
def tolerant_confusion(spark, d):
    curve = intervals.sta_lta(src.multi(spark, d), COMP, 48, 6).groupBy("station", "n").agg(F.max("ratio").alias("a"), F.min("ratio").alias("b"))
    return score.tolerant(curve.select("station", "n", (F.col("a") > 1.5).alias("truth"), (F.col("b") > 1.0).alias("guess")), ["station"], 0.5, 6)


@query
def label_octaves(spark, d):
    return label.label(_cells(spark, d).where("keep").select("tr", "k", "m"), TR, (1, 1), (0, 2), octaves=0.5)


@query
def detector_components(spark, d):
    return rounded(detectors.detect(src.multi(spark, d), COMP, P, N, component="component")["intervals"], 4, "t_start", "t_end")


@query
def repaired_picks(spark, d):
    pairs = match.paired(*_sides(spark, d), TR, 3600.0, strict=True)
    return rounded(rounded(match.repair(pairs.select("tr", "i", F.col("ta").alias("strong"), F.col("tb").alias("weak")), TR), 6, "strong"), 4, "weak")


def oracle() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
