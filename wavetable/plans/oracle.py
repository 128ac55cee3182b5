"""The queries of the registry as DuckDB SQL, from named parts."""

from __future__ import annotations

from wavetable.functions.constants import bin_groups, least_snr, spread, threshold

EPOCH = "TIMESTAMP '2024-01-01'"
HOUR = f"CAST(floor((epoch_us(ts) - epoch_us({EPOCH})) / 3600000000) AS BIGINT)"
SECONDS = f"(epoch_us(ts) - epoch_us({EPOCH})) / 1e6"
RHO, LOW_RHO, LEAST, FRAMES, BINS, EDGE = 4.0, 3.0, 30, 120, 17, 2
STEP, DF = "6.0::DOUBLE", "0.03125::DOUBLE"
STEP_VALUE = 6.0


def islands(src: str, keys: str, at: str) -> str:
    return f"SELECT {keys}, min({at}) AS s, max({at}) AS e FROM (SELECT {keys}, {at}, {at} - row_number() OVER (PARTITION BY {keys} ORDER BY {at}) AS run FROM {src}) GROUP BY {keys}, run"


def merged(src: str, keys: str, gap: float) -> str:
    test = f"p IS NULL OR s - p >= {gap}" if gap > 0 else "p IS NULL OR s > p"
    return (
        f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY s) - 1 AS interval_id, s, e FROM (SELECT {keys}, min(s) AS s, max(e) AS e FROM ("
        f"SELECT *, sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS id FROM ("
        f"SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ({src}))) GROUP BY {keys}, id)"
    )


def peaks(spans: str, curve: str, keys: str, at: str, value: str) -> str:
    using = ", ".join(keys.split(", "))
    return f"SELECT {keys}, interval_id, s, e, arg_min({at}, ({value} * -1, {at})) AS at_peak, max({value}) AS peak FROM {spans} JOIN {curve} USING ({using}) WHERE {at} BETWEEN s AND e GROUP BY ALL"


def stft(series: str, keys: str) -> str:
    return (
        f"SELECT {keys}, k, m, re, im, sqrt(re * re + im * im) AS amp FROM (SELECT {keys}, k, m, sum(x * win * cos(2 * pi() * k * w / 32)) AS re, -sum(x * win * sin(2 * pi() * k * w / 32)) AS im FROM "
        "(SELECT m, w, CASE WHEN p < 0 THEN -p WHEN p > 719 THEN 1438 - p ELSE p END AS n, 0.5 - 0.5 * cos(2 * pi() * w / 24) AS win FROM (SELECT m, w, m * 6 - 12 + w AS p FROM range(120) a(m), range(24) b(w))) f "
        f"JOIN {series} USING (n), range(17) c(k) GROUP BY ALL)"
    )


def ranked(src: str, keys: str, group: str, rho: float) -> str:
    d = f"CASE WHEN k IN (0, {BINS - 1}) THEN 1 ELSE 2 END"
    by = f"PARTITION BY {keys}, g"
    return (
        f"SELECT *, amp <= s * xi AND s * xi < nx AS hit FROM (SELECT *, sum(amp) OVER (w ROWS UNBOUNDED PRECEDING) / r / CASE WHEN d = 1 THEN {spread(1)!r} ELSE {spread(2)!r} END AS s FROM ("
        f"SELECT *, row_number() OVER w AS r, lead(amp) OVER w AS nx, count(*) OVER ({by}) AS n, CASE WHEN d = 1 THEN {threshold(1, rho)!r} ELSE {threshold(2, rho)!r} END AS xi "
        f"FROM (SELECT *, {group} AS g, {d} AS d FROM {src}) WINDOW w AS ({by} ORDER BY amp, k, m)) WINDOW w AS ({by} ORDER BY amp, k, m))"
    )


def sigma(src: str, keys: str, branch: str) -> str:
    first, before = f"min_by(s, r) FILTER (WHERE hit AND r >= {LEAST})", f"max_by(s, r) FILTER (WHERE hit AND r < {LEAST})"
    end, small = "max_by(s, r) FILTER (WHERE r <= greatest(1, n - 1))", f"max(s) FILTER (WHERE r = {LEAST + 1} AND n > {LEAST + 1})"
    picks = {"high": (first, end), "low": (first, before, small, end), "original": (first, small, end)}[branch]
    return f"SELECT {keys}, g, count(*) AS n, coalesce({', '.join(picks)}) AS sigma, min(xi) AS xi FROM {src} GROUP BY {keys}, g"


GROUPS = bin_groups(BINS, 5)
GROUP_CASE = "CASE " + " ".join(f"WHEN k BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(GROUPS)) + " END"


def cells(src: str, sig: str, keys: str) -> str:
    return f"SELECT c.*, sigma, amp / (sigma + 1e-8) AS snr, amp > sigma * xi AND m >= {EDGE} AND m < {FRAMES - EDGE - 1} AS keep FROM {src} c JOIN {sig} z ON {' AND '.join(f'c.{k} = z.{k}' for k in keys.split(', '))} AND c.k = z.g"


def labels(mask: str, keys: str, dims: str, least: str, near: str | None = None) -> tuple[str, str]:
    """(recursive part's name and body, labelled cells) of a mask; ``near`` tells which cells b touch r."""
    d = dims.split(", ")
    near = near or " AND ".join(f"abs(b.{x} - r.{x}) <= 1" for x in d)
    root = ", ".join(f"r{x}" for x in d)
    code = f"CAST(r{d[0]} AS BIGINT)"
    for x in d[1:]:
        code = f"({code}) * 1000 + r{x}"
    walk = f"reach({keys}, {dims}, {root}) AS (SELECT {keys}, {dims}, {dims} FROM {mask} UNION SELECT {', '.join('b.' + k for k in keys.split(', '))}, {', '.join('b.' + x for x in d)}, {', '.join('r.r' + x for x in d)} FROM reach r JOIN {mask} b ON {' AND '.join(f'b.{k} = r.{k}' for k in keys.split(', '))} AND {near})"
    lab = (
        f"SELECT {keys}, {dims}, dense_rank() OVER (PARTITION BY {keys} ORDER BY root) AS cluster_id FROM (SELECT {keys}, {dims}, min({code}) AS root FROM reach GROUP BY ALL) SEMI JOIN "
        f"(SELECT {keys}, root FROM (SELECT {keys}, {dims}, min({code}) AS root FROM reach GROUP BY ALL) GROUP BY ALL HAVING {least}) USING ({keys}, root)"
    )
    return walk, lab


BASE: dict[str, str] = {
    "series": f"SELECT tr, n, coalesce(x, 0.0) AS x FROM (SELECT tr, n FROM (SELECT DISTINCT event_type AS tr FROM events), (SELECT unnest(range(720)) AS n)) LEFT JOIN (SELECT event_type AS tr, {HOUR} AS n, round(sum(value), 4) AS x FROM events GROUP BY ALL) USING (tr, n)",
    "multi": f"SELECT component, station, n, coalesce(x, 0.0) AS x FROM (SELECT component, station, n FROM (SELECT DISTINCT user_id % 3 AS component, event_type AS station FROM events), (SELECT unnest(range(720)) AS n)) LEFT JOIN (SELECT user_id % 3 AS component, event_type AS station, {HOUR} AS n, round(sum(value), 4) AS x FROM events GROUP BY ALL) USING (component, station, n)",
}


def ratio(src: str, keys: str) -> str:
    return (
        f"SELECT {keys}, p AS n, sta / (lta + 1e-16) * 8.0 AS ratio FROM (SELECT {keys}, p, sum(x * x) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS sta, sum(x * x) OVER (w ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS lta "
        f"FROM (SELECT {keys}, p, x FROM (SELECT p, CASE WHEN p < 0 THEN -p WHEN p > 719 THEN 1438 - p ELSE p END AS n FROM range(-47, 725) t(p)) JOIN {src} USING (n)) WINDOW w AS (PARTITION BY {keys} ORDER BY p)) WHERE p BETWEEN 0 AND 719"
    )


BASE |= {
    "sta": ratio("series", "tr"),
    "sta_spans": merged(islands("(SELECT tr, n FROM sta WHERE ratio > 1.25)", "tr", "n"), "tr", 3),
    "sta_multi": ratio("multi", "component, station"),
    "tf": stft("series", "tr"),
    "tf_multi": stft("multi", "component, station"),
    "model": "SELECT tr, k, avg(amp * amp) AS mean, stddev_pop(amp * amp) AS std FROM tf WHERE m < 60 GROUP BY ALL",
    "scores": f"SELECT tr, k, m, CASE WHEN z >= 1 AND m >= {EDGE} AND m < {FRAMES - EDGE - 1} THEN z ELSE 0.0 END AS z FROM (SELECT tr, k, m, (amp * amp - mean) / (std + 1e-16) AS z FROM tf JOIN model USING (tr, k))",
    "power": "SELECT tr, m, sum(z) / 17 AS likelihood FROM scores GROUP BY ALL",
    "power_spans": merged(islands("(SELECT tr, m FROM power WHERE likelihood > 0.5)", "tr", "m"), "tr", 2),
    "rank_high": ranked("tf", "tr", "k", RHO), "rank_low": ranked("tf", "tr", "k", LOW_RHO), "rank_groups": ranked("tf", "tr", GROUP_CASE, RHO), "rank_multi": ranked("tf_multi", "component, station", "k", RHO),
    "sig_high": sigma("rank_high", "tr", "high"), "sig_low": sigma("rank_low", "tr", "low"), "sig_original": sigma("rank_high", "tr", "original"), "sig_groups": sigma("rank_groups", "tr", "high"), "sig_multi": sigma("rank_multi", "component, station", "high"),
    "cells": cells("tf", "sig_high", "tr"),
    "cells_multi": cells("tf_multi", "sig_multi", "component, station"),
    "mask": "SELECT tr, k, m FROM cells WHERE keep",
    "ordered": "SELECT station, dense_rank() OVER (ORDER BY station) - 1 AS c FROM (SELECT DISTINCT event_type AS station FROM events)",
    "mask_multi": "SELECT component, c, k, m FROM cells_multi JOIN ordered USING (station) WHERE keep",
}
WALK, LABELS = labels("mask", "tr", "k, m", "max(k) - min(k) + 1 >= 2 AND max(m) - min(m) + 1 >= 2")
WALK_C, LABELS_C = labels("mask_multi", "component", "c, k, m", "max(k) - min(k) + 1 >= 2 AND max(m) - min(m) + 1 >= 2 AND count(DISTINCT c) >= 2")
WALK_O, LABELS_O = labels("mask", "tr", "k, m", "max(m) - min(m) + 1 >= 2", "abs(b.m - r.m) <= 1 AND b.k BETWEEN least(r.k - 1, round_even(r.k * pow(2.0::DOUBLE, -0.5), 0)) AND greatest(r.k + 1, round_even(r.k * pow(2.0::DOUBLE, 0.5), 0))")
HALF = f"({STEP} * m / (m + 1) / 2)"
LABELLED: dict[str, str] = {
    "reach": WALK,
    "labels": LABELS,
    "inside": "SELECT tr, k, m, amp, snr, re, im, cluster_id FROM cells JOIN labels USING (tr, k, m)",
    "catalog": (
        f"SELECT tr, cluster_id, min({STEP} * m - {HALF}) AS time_start, max({STEP} * m + {HALF}) AS time_end, arg_min({STEP} * m, (-amp, k, m)) AS time_peak, min(k * {DF}) AS frequency_start, max(k * {DF}) AS frequency_end, "
        f"arg_min(k * {DF}, (-amp, k, m)) AS frequency_peak, max(amp) AS energy_peak, avg(amp) AS energy_mean, sum(amp) AS energy_sum, sum(snr) AS snr_sum, avg(snr) AS snr_mean, max(snr) AS snr_peak FROM inside GROUP BY tr, cluster_id"
    ),
    "kept": "SELECT * FROM catalog WHERE snr_peak > 3 AND time_end - time_start > 12",
    "likely": "SELECT tr, m, sum(snr) AS likelihood FROM inside GROUP BY ALL",
    "grid": f"SELECT tr, CAST(floor(time_start / {STEP}) AS BIGINT) AS s, CAST(floor(time_end / {STEP}) AS BIGINT) AS e FROM catalog",
    "touch": f"SELECT tr, s * {STEP} AS s, e * {STEP} AS e FROM (SELECT tr, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS id FROM (SELECT *, max(e) OVER (PARTITION BY tr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM grid)) GROUP BY tr, id)",
    "spans": f"SELECT tr, interval_id, s AS t_start, e + {STEP_VALUE / 2} AS t_end FROM ({merged('SELECT * FROM touch', 'tr', STEP_VALUE)})",
    "placed": "SELECT * FROM (SELECT c.*, interval_id, t_start, t_end, row_number() OVER (PARTITION BY c.tr, cluster_id ORDER BY greatest(t_start - (time_start + time_end) / 2, (time_start + time_end) / 2 - t_end, 0.0), interval_id) AS r FROM catalog c JOIN spans USING (tr)) WHERE r = 1",
}


def pairs(a: str, b: str, out: str, reach: float) -> dict[str, str]:
    """Parts that give ``out``: (tr, i, ta, j, tb) of matched rows and those alone, from a (tr, i, t) and b (tr, j, t)."""
    return {
        f"{out}_near": f"SELECT {a}.tr, i, {a}.t AS ta, j, {b}.t AS tb, abs({a}.t - {b}.t) AS d FROM {a} JOIN {b} ON {a}.tr = {b}.tr AND {a}.t BETWEEN {b}.t - {reach} AND {b}.t + {reach} WHERE abs({a}.t - {b}.t) <= {reach}",
        f"{out}_rank": f"SELECT *, row_number() OVER (PARTITION BY tr, i ORDER BY d, j) AS rj, row_number() OVER (PARTITION BY tr, j ORDER BY d, i) AS ri FROM {out}_near",
        f"{out}_pair": f"SELECT tr, i, ta, j, tb FROM (SELECT *, row_number() OVER (PARTITION BY tr, i ORDER BY d, j) AS q FROM {out}_rank WHERE ri = 1) WHERE q = 1 UNION SELECT tr, i, ta, j, tb FROM (SELECT *, row_number() OVER (PARTITION BY tr, j ORDER BY d, i) AS q FROM {out}_rank WHERE rj = 1) WHERE q = 1",
        out: f"SELECT * FROM {out}_pair UNION ALL SELECT tr, i, t, NULL, NULL FROM {a} ANTI JOIN {out}_pair USING (tr, i) UNION ALL SELECT tr, NULL, NULL, j, t FROM {b} ANTI JOIN {out}_pair USING (tr, j)",
    }


def side(event_type: str, name: str, extra: str = "") -> str:
    return f"SELECT tr, t, row_number() OVER (PARTITION BY tr ORDER BY t) AS {name} FROM (SELECT user_id % 10 AS tr, {SECONDS} AS t FROM events WHERE event_type = '{event_type}'{extra})"


PICKS = {"truth": side("purchase", "i"), "guess": side("error", "j"), **pairs("truth", "guess", "found", 3600.0)}
STATIONS = {f"st{s}": side("purchase", "j" if s else "i", f" AND user_id % 3 = {s}") for s in range(3)}
ASSOCIATION = {
    **STATIONS,
    **pairs("st0", "st1", "one", 7200.0),
    "two_in": "SELECT *, row_number() OVER (PARTITION BY tr ORDER BY t NULLS LAST, t0 NULLS FIRST, t1 NULLS FIRST) AS i FROM (SELECT tr, ta AS t0, tb AS t1, CASE WHEN ta IS NULL THEN tb WHEN tb IS NULL THEN ta ELSE (ta + tb) / 2 END AS t FROM one)",
    **pairs("two_in", "st2", "two", 7200.0),
    "all_three": "SELECT * FROM (SELECT coalesce(a.tr, b.tr) AS tr, t0, t1, tb AS t2 FROM two_in a FULL JOIN two b ON a.tr = b.tr AND a.i = b.i) WHERE (t0 IS NOT NULL)::INT + (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT >= 2",
    "events_found": "SELECT *, row_number() OVER (PARTITION BY tr ORDER BY least(t0, t1, t2), t0 NULLS FIRST, t1 NULLS FIRST, t2 NULLS FIRST) AS event FROM all_three",
}


def rebuilt(src: str) -> str:
    """(tr, n, x): overlap-add of the cells (tr, k, m, re, im) of every frame."""
    win = "(0.5 - 0.5 * cos(2 * pi() * w / 24))"
    return (
        f"SELECT tr, n, sum(v) / max(q) AS x FROM (SELECT tr, m * 6 - 12 + w AS n, {win} * sum(CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * w / 32) - im * sin(2 * pi() * k * w / 32))) / 32 AS v, 0 AS q FROM {src}, (SELECT w FROM range(24) t(w)) GROUP BY tr, m, w "
        f"UNION ALL SELECT tr, n, 0.0, q FROM (SELECT DISTINCT tr FROM series), (SELECT m * 6 - 12 + w AS n, sum({win} * {win}) AS q FROM range(120) a(m), range(24) b(w) GROUP BY 1)) WHERE n BETWEEN 0 AND 719 GROUP BY tr, n"
    )


def filtered(gain: str) -> dict[str, str]:
    """Parts that give ``smooth`` (tr, n, x): the trace and its mirror image through the gain at frequency f, by a plain Fourier sum."""
    return {
        "mirrored": "SELECT tr, n, x FROM series UNION ALL SELECT tr, 1439 - n, x FROM series",
        "spectrum": f"SELECT tr, j, sum(x * cos(2 * pi() * (j * n % 1440) / 1440)) * any_value(g) AS re, -sum(x * sin(2 * pi() * (j * n % 1440) / 1440)) * any_value(g) AS im FROM mirrored, (SELECT j, {gain} AS g FROM (SELECT j, tan(pi() * least(j / 1440::DOUBLE, 0.5 - 1e-12)) AS warp FROM range(721) t(j))) GROUP BY tr, j",
        "smooth": "SELECT tr, n, sum(CASE WHEN j IN (0, 720) THEN 1 ELSE 2 END * (re * cos(2 * pi() * (j * n % 1440) / 1440) - im * sin(2 * pi() * (j * n % 1440) / 1440))) / 1440 AS x FROM spectrum, (SELECT n FROM range(720) t(n)) GROUP BY tr, n",
    }


def low_pass(edge: str, order: int) -> str:
    return f"1 / (1 + pow(warp / tan(pi() * {edge}), {2 * order}))"


def high_pass(edge: str, order: int) -> str:
    return f"CASE WHEN warp = 0 THEN 0 ELSE 1 / (1 + pow(tan(pi() * {edge}) / nullif(warp, 0), {2 * order})) END"


def sql(select: str, *parts: dict[str, str]) -> str:
    """WITH the parts, each given by name, and the select."""
    named = {k: v for p in parts for k, v in p.items()}
    body = ",\n".join(v if k == "reach" else f"{k} AS ({v})" for k, v in named.items())
    return f"WITH RECURSIVE {body}\n{select}" if named else select


def r(column: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({column}, {digits}) + 0.0 AS {name or column}"


CATALOG_COLUMNS = ("time_start", "time_end", "time_peak", "frequency_start", "frequency_end", "frequency_peak", "energy_peak", "energy_mean", "energy_sum", "snr_sum", "snr_mean", "snr_peak")
CATALOG_OUT = ", ".join(r(c, 4) for c in CATALOG_COLUMNS)
MOMENTS = [(i, j) for i in range(5) for j in range(5 - i) if i + j >= 2]
MOMENT_SQL = "SELECT tr, cluster_id, sum(amp) AS m00, any_value(f0) AS m10, any_value(t0) AS m01, " + ", ".join(
    f"sum(amp{f' * (k * {DF} - f0)' * i}{f' * (m * {STEP} - t0)' * j}) / sum(amp) AS m{i}{j}" for i, j in MOMENTS
) + f" FROM (SELECT *, sum(amp * k * {DF}) OVER w / sum(amp) OVER w AS f0, sum(amp * m * {STEP}) OVER w / sum(amp) OVER w AS t0 FROM inside WINDOW w AS (PARTITION BY tr, cluster_id)) GROUP BY tr, cluster_id"
DIST = "row_number() OVER (PARTITION BY tr ORDER BY energy_peak DESC, cluster_id)"

POINTS = {"points": f"SELECT tr, cluster_id, m, k * {DF} AS f, pow(amp / max(amp) OVER w, 2) AS w, 2.0 * (m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0) - 1 AS u FROM inside WINDOW w AS (PARTITION BY tr, cluster_id)"}
WEIGHED = "SELECT tr, cluster_id, count(DISTINCT m) AS frames, " + ", ".join(f"sum(w{p}) AS {n}" for n, p in (("s", ""), ("su", " * u"), ("suu", " * u * u"), ("s3", " * u * u * u"), ("s4", " * u * u * u * u"), ("sf", " * f"), ("suf", " * u * f"), ("suuf", " * u * u * f"))) + " FROM points GROUP BY tr, cluster_id"

ORACLE: dict[str, str] = {
    "series_hourly": sql("SELECT * FROM series", BASE),
    "sta_lta_ratio": sql(f"SELECT tr, n, {r('ratio')} FROM sta", BASE),
    "sta_lta_intervals": sql("SELECT tr, interval_id, s AS n_start, e AS n_end FROM sta_spans", BASE),
    "sta_lta_peaks": sql(f"SELECT tr, interval_id, s AS n_start, e AS n_end, at_peak AS n_peak, {r('peak')} FROM ({peaks('sta_spans', 'sta', 'tr', 'n', 'ratio')})", BASE),
    "curve_component_max": sql("SELECT station, n, round(max(ratio), 6) + 0.0 AS ratio FROM sta_multi GROUP BY ALL", BASE),
    "stft_amplitude": sql(f"SELECT tr, k, m, {r('amp')} FROM tf", BASE),
    "stft_band_power": sql("SELECT tr, m, round(sum(amp * amp), 4) + 0.0 AS power FROM tf WHERE k BETWEEN 2 AND 8 GROUP BY ALL", BASE),
    "psd_noise_model": sql(f"SELECT tr, k, {r('mean', 3)}, {r('std', 3)} FROM model", BASE),
    "psd_zscore_trim": sql(f"SELECT tr, k, m, {r('z')} FROM scores WHERE z > 0", BASE),
    "psd_likelihood": sql(f"SELECT tr, m, {r('likelihood')} FROM power", BASE),
    "psd_intervals": sql(f"SELECT tr, interval_id, s AS m_start, e AS m_end, at_peak AS m_peak, {r('peak')} FROM ({peaks('power_spans', 'power', 'tr', 'm', 'likelihood')})", BASE),
    "noise_sigma_max": sql(f"SELECT tr, g, n, {r('sigma')} FROM sig_high", BASE),
    "noise_sigma_low_snr": sql(f"SELECT tr, g, n, {r('sigma')} FROM sig_low", BASE),
    "noise_sigma_original": sql(f"SELECT tr, g, n, {r('sigma')} FROM sig_original", BASE),
    "noise_sigma_grouped": sql(f"SELECT tr, CAST(g AS BIGINT) AS g, n, {r('sigma')} FROM sig_groups", BASE),
    "trim_mask": sql("SELECT tr, k, m FROM mask", BASE),
    "snr_cells": sql(f"SELECT tr, k, m, {r('snr')}, keep FROM cells", BASE),
    "snr_cells_auto": sql(f"SELECT tr, k, m, {r('snr')}, keep FROM cells_auto", BASE, {"rank_auto": ranked("tf", "tr", "k", least_snr(FRAMES - 1, 2)), "sig_auto": sigma("rank_auto", "tr", "low"), "cells_auto": cells("tf", "sig_auto", "tr")}),
    "mask_any_component": sql("SELECT station, k, m, bool_or(keep) AS keep FROM cells_multi GROUP BY ALL", BASE),
    "label_cells": sql("SELECT tr, k, m, cluster_id FROM labels", BASE, LABELLED),
    "label_cells_multitrace": sql("SELECT component, c, k, m, cluster_id FROM labels", BASE, {"reach": WALK_C, "labels": LABELS_C}),
    "label_octaves": sql("SELECT tr, k, m, cluster_id FROM labels", BASE, {"reach": WALK_O, "labels": LABELS_O}),
    "cluster_extent_filter": sql("SELECT tr, cluster_id, min(k) AS k_lo, max(k) AS k_hi, min(m) AS m_lo, max(m) AS m_hi, count(*) AS cells FROM labels GROUP BY ALL HAVING max(k) - min(k) >= 2 AND max(m) - min(m) >= 2", BASE, LABELLED),
    "catalog_bbox": sql(f"SELECT tr, cluster_id, {CATALOG_OUT} FROM catalog", BASE, LABELLED),
    "catalog_energy_stats": sql(
        "SELECT tr, cluster_id, round(min(amp), 4) AS e_min, round(max(amp), 4) AS e_max, round(avg(amp), 4) AS e_mean, round(stddev_samp(amp), 4) AS e_std, round(CASE WHEN count(*) > 2 THEN skewness(amp) END, 4) + 0.0 AS e_skew, round(CASE WHEN count(*) > 3 THEN kurtosis(amp) END, 4) + 0.0 AS e_kurtosis, "
        "round(exp(avg(ln(amp))) / avg(amp), 6) AS e_flatness, round(ln(sum(amp)) - sum(amp * ln(amp)) / sum(amp), 6) AS e_entropy FROM inside GROUP BY tr, cluster_id", BASE, LABELLED),
    "catalog_moments": sql("SELECT tr, cluster_id, " + ", ".join(f"round(m{n}, 4) + 0.0 AS m{n}" for n in ["00", "10", "01", "20", "11", "02", "30", "03", "40", "04"]) + ", round(sqrt(m20), 6) AS f_std, round(sqrt(m02), 6) AS t_std, round(CASE WHEN m02 > 0 THEN m04 / (m02 * m02) END, 4) AS t_kurtosis FROM (" + MOMENT_SQL + ")", BASE, LABELLED),
    "catalog_peak_arrival": sql(f"SELECT tr, cluster_id, round(coalesce(max(m) FILTER (WHERE l >= amp), min(m)) * {STEP}, 6) AS arrival FROM (SELECT *, lag(amp) OVER (PARTITION BY tr, cluster_id ORDER BY m) AS l FROM (SELECT i.* FROM inside i JOIN (SELECT tr, cluster_id, arg_min(k, (-amp, k, m)) AS pk, arg_min(m, (-amp, k, m)) AS pm FROM inside GROUP BY ALL) p ON i.tr = p.tr AND i.cluster_id = p.cluster_id AND k = pk AND m <= pm)) GROUP BY ALL", BASE, LABELLED),
    "catalog_line": sql("SELECT tr, cluster_id, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM (SELECT tr, cluster_id, (sf - c1 * su) / s AS c0, c1 FROM (SELECT *, (s * suf - su * sf) / nullif(s * suu - su * su, 0) AS c1 FROM (" + WEIGHED + ")))", BASE, LABELLED, POINTS),
    "catalog_parabola": sql(
        "SELECT tr, cluster_id, round(d0 / nullif(d, 0), 4) + 0.0 AS c0, round(d1 / nullif(d, 0), 4) + 0.0 AS c1, round(d2 / nullif(d, 0), 4) + 0.0 AS c2 FROM (SELECT tr, cluster_id, CASE WHEN frames > 2 THEN s * (suu * s4 - s3 * s3) - su * (su * s4 - s3 * suu) + suu * (su * s3 - suu * suu) END AS d, "
        "sf * (suu * s4 - s3 * s3) - su * (suf * s4 - s3 * suuf) + suu * (suf * s3 - suu * suuf) AS d0, s * (suf * s4 - s3 * suuf) - sf * (su * s4 - s3 * suu) + suu * (su * suuf - suf * suu) AS d1, s * (suu * suuf - suf * s3) - su * (su * suuf - suf * suu) + sf * (su * s3 - suu * suu) AS d2 FROM ("
        + WEIGHED.replace("* f", "* ln(f) / ln(2)").replace("FROM points", "FROM points_above") + "))", BASE, LABELLED, {"points_above": POINTS["points"].replace("FROM inside", "FROM inside WHERE k > 0")}),
    "catalog_start": sql(f"SELECT tr, cluster_id, round(min(m) * {STEP}, 6) AS arrival FROM (SELECT i.* FROM inside i JOIN (SELECT tr, cluster_id, arg_min(k, (-amp, k, m)) AS pk FROM inside GROUP BY ALL) p ON i.tr = p.tr AND i.cluster_id = p.cluster_id AND k = pk) GROUP BY ALL", BASE, LABELLED),
    "component_energy": sql("SELECT station, k, m, round(sqrt(sum(amp * amp)), 4) AS amp FROM tf_multi GROUP BY ALL", BASE),
    "noise_sigma_robust": sql(f"SELECT tr, g, n, {r('sigma')} FROM (SELECT tr, g, count(*) AS n, coalesce(min_by(s, r) FILTER (WHERE hit), max_by(s, r) FILTER (WHERE r <= n / 2), max_by(s, r) FILTER (WHERE r <= greatest(1, n - 1))) AS sigma FROM rank_high GROUP BY ALL)", BASE),
    "noise_threshold_sigma": sql(f"SELECT tr, g AS k, round(sigma * xi, 6) AS eta, round(sigma * xi / CASE WHEN g IN (0, {BINS - 1}) THEN {threshold(1, RHO)!r} ELSE {threshold(2, RHO)!r} END, 6) AS sigma FROM sig_high", BASE),
    "label_hulls": sql("SELECT tr, interval_id, s AS m_start, e AS m_end FROM (" + merged("SELECT tr, min(m) AS s, max(m) AS e FROM labels GROUP BY tr, cluster_id", "tr", 2) + ")", BASE, LABELLED),
    "cluster_periods": sql(f"SELECT tr, cluster_id, round(sum(amp) / nullif(sum(amp * k * {DF}), 0), 4) AS centroid, round(1 / nullif(arg_min(k, (-amp, k)) * {DF}, 0), 4) AS peak, round(sqrt(sum(amp * m * m * {STEP} * {STEP}) / sum(amp) - pow(sum(amp * m * {STEP}) / sum(amp), 2)), 4) + 0.0 AS time FROM inside GROUP BY ALL", BASE, LABELLED),
    "cluster_projection": sql("SELECT tr, cluster_id, m, round(c / max(c) OVER (PARTITION BY tr, cluster_id), 6) AS curve FROM (SELECT tr, cluster_id, m, sum(amp) / max(count(*)) OVER (PARTITION BY tr, cluster_id) AS c FROM inside GROUP BY tr, cluster_id, m)", BASE, LABELLED),
    "cells_smoothed": sql("SELECT a.tr, a.cluster_id, a.k, a.m, round(avg(b.amp), 4) AS amp FROM inside a JOIN inside b ON a.tr = b.tr AND a.cluster_id = b.cluster_id AND abs(a.k - b.k) <= 1 AND abs(a.m - b.m) <= 1 GROUP BY ALL", BASE, LABELLED),
    "series_chunks": sql("SELECT tr, n // 100 AS chunk_id, count(*) AS samples, round(sum(x), 4) + 0.0 AS total FROM series GROUP BY ALL", BASE),
    "detrended": sql("SELECT tr, n, round(x - c - s * (n - m), 4) + 0.0 AS x FROM series JOIN (SELECT tr, avg(x) AS c, avg(n) AS m, regr_slope(x, n) AS s FROM series GROUP BY tr) USING (tr)", BASE),
    "envelope_curve": sql(
        "SELECT tr, n, round(sqrt(pow(sum(h * (re * cos(2 * pi() * (j * n % 720) / 720) - im * sin(2 * pi() * (j * n % 720) / 720))), 2) + pow(sum(h * (re * sin(2 * pi() * (j * n % 720) / 720) + im * cos(2 * pi() * (j * n % 720) / 720))), 2)) / 720, 4) AS x "
        "FROM (SELECT tr, j, CASE WHEN j IN (0, 360) THEN 1 ELSE 2 END AS h, sum(x * cos(2 * pi() * (j * n % 720) / 720)) AS re, -sum(x * sin(2 * pi() * (j * n % 720) / 720)) AS im FROM series, range(361) t(j) GROUP BY tr, j), (SELECT n FROM range(720) t(n)) GROUP BY tr, n", BASE),
    "picks_aligned": sql("SELECT a.tr, a.i, round(a.t, 6) AS t, coalesce(j, -1) AS index FROM (SELECT *, CASE WHEN t IS NOT NULL THEN row_number() OVER (PARTITION BY tr ORDER BY t NULLS LAST, i) END AS q FROM (SELECT tr, i, min(tb) AS t FROM found WHERE i IS NOT NULL GROUP BY ALL)) a LEFT JOIN (SELECT tr, j, row_number() OVER (PARTITION BY tr ORDER BY t, j) AS q FROM (SELECT tr, j, min(tb) AS t FROM found WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL)) b ON a.tr = b.tr AND a.q = b.q", PICKS),
    "picks_near_points": sql("SELECT a.tr, i, j, round(sqrt(pow(a.t - b.t, 2) + pow(a.station - b.station, 2)), 6) AS d FROM sided a JOIN (SELECT tr, t, station, i AS j FROM sided_errors) b ON a.tr = b.tr AND a.t BETWEEN b.t - 1801 AND b.t + 1801 WHERE sqrt(pow(a.t - b.t, 2) + pow(a.station - b.station, 2)) <= 1800", {name: f"SELECT tr, t, station, row_number() OVER (PARTITION BY tr ORDER BY t, station) AS i FROM (SELECT user_id % 10 AS tr, user_id % 3 AS station, {SECONDS} AS t FROM events WHERE event_type = '{kind}')" for name, kind in (("sided", "purchase"), ("sided_errors", "error"))}),
    "denoiser_scores": sql("SELECT tr, round(sqrt(sum(pow(g.x - s.x, 2))), 4) AS l2, round(sum(abs(g.x - s.x)) / sum(abs(s.x)), 4) AS rel_l1 FROM series s JOIN (" + rebuilt("(SELECT tr, m, k, CASE WHEN z > 0 THEN re ELSE 0.0 END AS re, CASE WHEN z > 0 THEN im ELSE 0.0 END AS im FROM tf JOIN scores USING (tr, k, m))") + ") g USING (tr, n) GROUP BY tr", BASE),
    "catalog_filtered": sql("SELECT l.tr, l.k, l.m, l.cluster_id FROM labels l SEMI JOIN kept USING (tr, cluster_id)", BASE, LABELLED),
    "catalog_outer_merge": sql("SELECT coalesce(a.tr, b.tr) AS tr, coalesce(a.cluster_id, b.cluster_id) AS cluster_id, round(a.snr_peak, 4) AS snr_peak_old, round(b.snr_peak, 4) AS snr_peak_new, round(b.energy_sum, 4) AS energy_sum FROM (SELECT * FROM catalog WHERE snr_peak > 3) a FULL JOIN (SELECT * FROM catalog WHERE time_end - time_start > 12) b ON a.tr = b.tr AND a.cluster_id = b.cluster_id", BASE, LABELLED),
    "catalog_append": sql("SELECT tr, cluster_id, round(time_start, 4) AS time_start, round(time_end, 4) AS time_end FROM catalog UNION ALL SELECT k.tr, k.cluster_id + coalesce(t.top, 0), round(time_start + 720, 4), round(time_end + 720, 4) FROM kept k LEFT JOIN (SELECT tr, max(cluster_id) AS top FROM catalog GROUP BY tr) t ON k.tr = t.tr", BASE, LABELLED),
    "likelihood_curve": sql(f"SELECT tr, m, {r('likelihood')} FROM likely", BASE, LABELLED),
    "intervals_islands": sql(f"SELECT tr, s AS m_start, e AS m_end FROM ({islands('(SELECT tr, m FROM likely WHERE likelihood > 4)', 'tr', 'm')})", BASE, LABELLED),
    "intervals_merged": sql("SELECT tr, interval_id, s AS m_start, e AS m_end FROM (" + merged("SELECT * FROM (" + islands("(SELECT tr, m FROM likely WHERE likelihood > 4)", "tr", "m") + ")", "tr", 3) + ")", BASE, LABELLED),
    "intervals_raster": sql("SELECT DISTINCT tr, unnest(range(s, e + 1)) AS n FROM sta_spans", BASE),
    "catalog_intervals": sql("SELECT tr, interval_id, round(t_start, 4) AS t_start, round(t_end, 4) AS t_end FROM spans", BASE, LABELLED),
    "interval_top_cluster": sql("SELECT tr, interval_id, cluster_id, round(time_peak, 4) AS time_peak, round(energy_peak, 4) AS energy_peak FROM (SELECT *, row_number() OVER (PARTITION BY tr, interval_id ORDER BY energy_peak DESC, cluster_id) AS q FROM placed) WHERE q = 1", BASE, LABELLED),
    "interval_overlap_window": sql("SELECT tr, interval_id, round(t_start, 4) AS t_start, round(t_end, 4) AS t_end FROM spans WHERE t_start <= 400 AND t_end >= 200", BASE, LABELLED),
    "interval_extend_clip": sql("SELECT tr, interval_id, round(greatest(0, t_start - (t_end - t_start)), 4) AS t_start, round(least(719, t_end + 6.0), 4) AS t_end FROM spans", BASE, LABELLED),
    "interval_segments": sql(f"SELECT round(s - (e + {STEP_VALUE / 2} - s) / 2, 4) AS t_start, round(e + {STEP_VALUE / 2} + (e + {STEP_VALUE / 2} - s) / 2, 4) AS t_end FROM (" + merged(f"SELECT 0 AS one, s * {STEP} AS s, e * {STEP} AS e FROM (SELECT min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS id FROM (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT CAST(floor(t_start / {STEP}) AS BIGINT) AS s, CAST(floor(t_end / {STEP}) AS BIGINT) AS e FROM spans))) GROUP BY id)", "one", STEP_VALUE) + ")", BASE, LABELLED),
    "event_cutouts": sql("SELECT s.tr, interval_id, n, x FROM spans p JOIN series s ON s.tr = p.tr AND n BETWEEN round_even(t_start, 0) AND round_even(t_end, 0)", BASE, LABELLED),
    "picks_pairs": sql("SELECT tr, i, j, round(abs(ta - tb), 6) AS d FROM found_pair", PICKS),
    "picks_full_match": sql("SELECT tr, i, round(ta, 6) AS ta, j, round(tb, 6) AS tb FROM found", PICKS),
    "picks_scores": sql("SELECT tr, tp, fp, fn, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall FROM (SELECT tr, count(*) FILTER (WHERE i IS NOT NULL AND j IS NOT NULL) AS tp, count(*) FILTER (WHERE i IS NULL) AS fp, count(*) FILTER (WHERE j IS NULL) AS fn FROM found GROUP BY tr)", PICKS),
    "picks_in_intervals": sql("SELECT tr, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn FROM (SELECT tr, count(v) AS tp, count(*) - count(v) AS fn FROM placed_picks GROUP BY tr) FULL JOIN (SELECT tr, count(*) AS fp FROM guess ANTI JOIN (SELECT tr, v AS j FROM placed_picks WHERE v IS NOT NULL) USING (tr, j) GROUP BY tr) USING (tr)", PICKS | {"placed_picks": "SELECT a.tr, i, min(j) AS v FROM truth a LEFT JOIN guess b ON a.tr = b.tr AND a.t BETWEEN b.t - 1800 AND b.t + 1800 GROUP BY a.tr, i"}),
    "f_beta_flags": "SELECT tp, fp, fn, round(1.25 * p * r / (0.25 * p + r + 1e-9), 6) AS f FROM (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn FROM labels))",
    "cross_entropy": "SELECT round(-avg(quality * ln(p + 1e-32) + (1 - quality) * ln(1 - p + 1e-32)), 6) AS cross_entropy FROM (SELECT quality, 0.1::DOUBLE + 0.8::DOUBLE * (1 - toxic) AS p FROM labels)",
    "lp_error": "SELECT a.label, a.station, round(pow(sum(pow(abs(b.x - a.x), 2)), 0.5), 6) AS error, round(exp(-pow(sum(pow(abs(b.x - a.x), 2)), 0.5)), 6) AS accuracy FROM (SELECT label, vec_id AS station, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS n FROM embeddings) a JOIN (SELECT vec_id - 1 AS station, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS n FROM embeddings) b ON a.station = b.station AND a.n = b.n GROUP BY a.label, a.station",
    "association_votes": sql("SELECT tr, event, station, round(t, 6) AS t FROM (SELECT tr, event, 0 AS station, t0 AS t FROM events_found UNION ALL SELECT tr, event, 1, t1 FROM events_found UNION ALL SELECT tr, event, 2, t2 FROM events_found) WHERE t IS NOT NULL", ASSOCIATION),
    "topk_clusters": sql(f"SELECT tr, cluster_id, rank, round(energy_peak, 4) AS energy_peak FROM (SELECT *, {DIST} AS rank FROM catalog) WHERE rank <= 3", BASE, LABELLED),
    "denoised_hourly": sql(
        "SELECT tr, n, round(x, 4) + 0.0 AS x FROM (" + rebuilt("(SELECT tr, m, k, CASE WHEN cluster_id IS NULL THEN 0.0 ELSE re END AS re, CASE WHEN cluster_id IS NULL THEN 0.0 ELSE im END AS im FROM cells LEFT JOIN labels USING (tr, k, m))") + ")", BASE, LABELLED),
    "denoised_power": sql("SELECT tr, n, round(x, 4) + 0.0 AS x FROM (" + rebuilt("(SELECT tr, m, k, CASE WHEN z > 0 THEN re ELSE 0.0 END AS re, CASE WHEN z > 0 THEN im ELSE 0.0 END AS im FROM tf JOIN scores USING (tr, k, m))") + ")", BASE),
    "decimated": sql("SELECT tr, n // 4 AS n, round(x, 4) + 0.0 AS x FROM smooth WHERE n % 4 = 0", BASE | filtered(low_pass("0.1", 8))),
    "denoised_bandpass": sql("SELECT tr, n, round(x, 4) + 0.0 AS x FROM smooth", BASE | filtered(low_pass("(1 / 6::DOUBLE)", 5) + " * " + high_pass("(1 / 48::DOUBLE)", 5))),
    "cwt_amplitude": sql(
        "SELECT tr, k, m, round(freq, 6) AS freq, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im, round(sqrt(re * re + im * im), 3) AS amp FROM (SELECT tr, k, m, any_value(freq) AS freq, "
        "sum(b * (re * cos(2 * pi() * (j * m % 720) / 720) - im * sin(2 * pi() * (j * m % 720) / 720))) / 720 AS re, sum(b * (re * sin(2 * pi() * (j * m % 720) / 720) + im * cos(2 * pi() * (j * m % 720) / 720))) / 720 AS im "
        "FROM (SELECT tr, j, k, freq, re, im, 2 * exp(-0.5 * pow(6 / (2 * pi() * freq) * 2 * pi() * j / 720 - 6, 2)) AS b FROM (SELECT tr, j, sum(x * cos(2 * pi() * (j * n % 720) / 720)) AS re, -sum(x * sin(2 * pi() * (j * n % 720) / 720)) AS im FROM series, range(1, 360) t(j) GROUP BY tr, j), "
        "(SELECT k, 0.5 * pow(2.0::DOUBLE, -k / 4.0) AS freq FROM range(CAST(floor(log2(90) * 4) AS BIGINT) + 1) t(k))) CROSS JOIN range(720) u(m) WHERE b > 1e-14 GROUP BY tr, k, m)", BASE),
    "detector_components": sql("SELECT tr AS station, interval_id, round(t_start, 4) AS t_start, round(t_end, 4) AS t_end FROM spans", BASE, {"mask_one": "SELECT DISTINCT station AS tr, k, m FROM cells_multi WHERE keep"}, {k: v.replace("FROM mask", "FROM mask_one").replace("JOIN mask ", "JOIN mask_one ") for k, v in LABELLED.items() if k in ("reach", "labels")}, {"catalog": f"SELECT tr, cluster_id, min({STEP} * m - {HALF}) AS time_start, max({STEP} * m + {HALF}) AS time_end FROM labels GROUP BY ALL"}, {k: LABELLED[k] for k in ("grid", "touch", "spans")}),
    "tolerant_confusion": sql(
        "SELECT station, CAST(sum(kind = 0 AND lost) AS BIGINT) AS fn, CAST(sum(kind = 0 AND NOT lost) AS BIGINT) AS tp, CAST(sum(CASE WHEN kind = 1 AND wrong THEN greatest(size // 6, 1) ELSE 0 END) AS BIGINT) AS fp, CAST(sum(kind = 2 OR (kind = 1 AND NOT wrong AND sides = 2)) AS BIGINT) AS tn "
        "FROM (SELECT station, kind, size, missed > 0.5 * size AS lost, sides, size > 6 OR sides = 0 AS wrong FROM (SELECT station, any_value(kind) AS kind, count(*) AS size, sum(NOT g) AS missed, coalesce(arg_min(before, n), 0) + coalesce(arg_max(after, n), 0) AS sides FROM "
        "(SELECT *, sum(new) OVER (PARTITION BY station ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS new, lag((t AND g)::INT, 1, 0) OVER w AS before, lead((t AND g)::INT, 1, 0) OVER w AS after FROM "
        "(SELECT *, CASE WHEN t THEN 0 WHEN g THEN 1 ELSE 2 END AS kind FROM (SELECT station, n, max(ratio) > 1.5 AS t, min(ratio) > 1.0 AS g FROM sta_multi GROUP BY ALL)) WINDOW w AS (PARTITION BY station ORDER BY n))) GROUP BY station, run)) GROUP BY station", BASE),
    "repaired_picks": sql(
        "SELECT tr, i, round(strong, 6) AS strong, round(CASE WHEN odd AND slope IS NOT NULL THEN middle + slope * (strong - centre) ELSE weak END, 4) AS weak, odd FROM scan LEFT JOIN (SELECT tr, regr_slope(weak, strong) AS slope, avg(weak) AS middle, avg(strong) AS centre FROM scan WHERE NOT odd GROUP BY tr) USING (tr)",
        PICKS | {"mutual": "SELECT tr, i, ta AS strong, tb AS weak, row_number() OVER (PARTITION BY tr ORDER BY ta, i) AS q FROM found_rank WHERE ri = 1 AND rj = 1"}
        | {"reach": "scan AS (SELECT tr, i, strong, weak, q, false AS odd, strong AS gs, weak AS gw FROM mutual WHERE q = 1 UNION ALL SELECT tr, i, strong, weak, q, odd, CASE WHEN odd THEN gs ELSE strong END, CASE WHEN odd THEN gw ELSE weak END FROM (SELECT m.*, gs, gw, abs(m.weak - gw - (m.strong - gs)) > abs(m.strong - gs) AS odd FROM scan s JOIN mutual m ON m.tr = s.tr AND m.q = s.q + 1))"}),
    "augment_grid": sql("SELECT tr, level, n, round(x + y / d * level, 6) + 0.0 AS x FROM series JOIN (SELECT n, x AS y, stddev_pop(x) OVER () AS d FROM series WHERE tr = 'error') USING (n), (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) l(level)", BASE),
    "series_daily": "SELECT flag, status, n, coalesce(x, 0.0) AS x FROM (SELECT flag, status, unnest(range(a, b + 1)) AS n FROM (SELECT flag, status, min(n) AS a, max(n) AS b FROM d GROUP BY ALL)) LEFT JOIN d USING (flag, status, n)",
}
ORACLE["series_daily"] = "WITH d AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS x FROM lineitem GROUP BY ALL) " + ORACLE["series_daily"]
