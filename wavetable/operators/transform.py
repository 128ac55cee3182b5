"""Time-frequency transforms on long traces.

Traces are cut into chunks of whole frames with the samples that these cover,
so a sample is shuffled once, but for those at the borders of chunks, and no
task holds a whole trace; a chunk's samples meet the FFT in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Samples of a chunk at least.
CHUNK = 4096
#: Cosine sums by name: the window is the sum of (-1)^j a_j cos(2 pi j n / size).
COSINES = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def window(size: int, name: str | tuple = "hann") -> np.ndarray:
    """A periodic analysis window; names with ``one`` are flat.

    A tuple gives parameters: ("kaiser", beta), ("gaussian", deviation in
    samples), ("tukey", share that is not flat), ("general_hamming", alpha).
    """
    kind, *rest = (name,) if isinstance(name, str) else name
    n = np.arange(size)
    if "one" in kind or kind == "boxcar":
        return np.ones(size)
    if kind == "cosine":
        return np.sin(np.pi * (n + 0.5) / (size + 1))
    if kind == "bartlett":
        return 1 - np.abs(2 * n / size - 1)
    if kind == "parzen":
        x = np.abs(2 * n - size) / (size + 1)
        return np.where(x <= 0.5, 1 - 6 * x**2 + 6 * x**3, 2 * (1 - x) ** 3)
    if kind == "kaiser" and rest:
        return np.i0(rest[0] * np.sqrt(np.maximum(0, 1 - (2 * n / size - 1) ** 2))) / np.i0(rest[0])
    if kind == "gaussian" and rest:
        return np.exp(-0.5 * ((n - size / 2) / rest[0]) ** 2)
    if kind == "tukey" and rest:
        x = np.minimum(n, size - n) * 2 / (max(rest[0], 1e-12) * size)
        return np.where(x < 1, 0.5 * (1 - np.cos(np.pi * x)), 1.0)
    terms = (rest[0], 1 - rest[0]) if kind == "general_hamming" and rest else COSINES.get(kind)
    if terms is None:
        raise ValueError(f"no window {name!r}")
    return sum((-1) ** j * a * np.cos(2 * np.pi * j * n / size) for j, a in enumerate(terms))


def frame_count(n: Column, hop: int) -> Column:
    return F.floor((n - 1) / hop).cast("long") + 1


def overlap_ok(win: np.ndarray, hop: int) -> bool:
    """Whether every sample keeps some weight, so that the transform can be inverted."""
    total = np.zeros(hop)
    np.add.at(total, np.arange(len(win)) % hop, win**2)
    return bool(total.min() > 1e-10)


def _padded(n: Column, size: Column, mode: str, margin: int) -> Column:
    """The padded places p in [-margin, size + margin) whose value is sample n's, as an array."""
    last = size - 1
    if mode == "reflect":
        left, right = -n, 2 * last - n
        return F.filter(F.array(n, F.when((n > 0) & (n <= margin), left), F.when((n < last) & (right < size + margin), right)), lambda p: p.isNotNull())
    if mode == "symmetric":
        left, right = -n - 1, 2 * size - 1 - n
        return F.filter(F.array(n, F.when(n < margin, left), F.when(right < size + margin, right)), lambda p: p.isNotNull())
    if mode == "replicate":
        grow = F.sequence(F.lit(1).cast("long"), F.lit(max(1, margin)).cast("long"))
        left = F.when(n == 0, F.transform(grow, lambda i: -i)).otherwise(F.array().cast("array<bigint>"))
        right = F.when(n == last, F.transform(grow, lambda i: last + i)).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.array(n), left, right)
    if mode == "wrap":
        return F.filter(F.array(n, F.when(n - size >= -margin, n - size), F.when(n < margin, n + size)), lambda p: p.isNotNull())
    if mode == "zero":
        return F.array(n)
    raise ValueError(f"no padding {mode!r}")


def pad(traces: DataFrame, keys: list[str], left: int, right: int, mode: str = "reflect") -> DataFrame:
    """(keys, p, x): padded places from -left to N - 1 + right."""
    sizes = traces.groupBy(*keys).agg((F.max("n") + 1).alias("_size"))
    out = traces.join(sizes, keys).withColumn("p", F.explode(_padded(F.col("n"), F.col("_size"), mode, max(left, right))))
    return out.where((F.col("p") >= -left) & (F.col("p") < F.col("_size") + right)).drop("_size")


def chunks(traces: DataFrame, keys: list[str], left: int, size: int, step: int, many: Column, mode: str = "reflect") -> DataFrame:
    """(keys, c, many, w, x): chunks as lists of places and samples, unordered.

    Chunk c has the padded samples from c * step - left on, ``size`` of them;
    there are ``many`` by the trace's length ``_size``. Places beyond the
    padding are missing and count as zeros.
    """
    sizes = traces.groupBy(*keys).agg((F.max("n") + 1).alias("_size"))
    wide = traces.join(sizes, keys).withColumn("_many", many).withColumn("p", F.explode(_padded(F.col("n"), F.col("_size"), mode, max(left, size - left))))
    q = F.col("p") + left
    low, high = F.greatest(F.lit(0).cast("long"), F.ceil((q - (size - 1)) / step)), F.least(F.floor(q / step), F.col("_many") - 1)
    wide = wide.where((q >= 0) & (low <= high)).withColumn("c", F.explode(F.sequence(low, high))).withColumn("w", (q - F.col("c") * step).cast("int"))
    return wide.groupBy(*keys, "c").agg(F.max("_size").alias("size"), F.collect_list("w").alias("w"), F.collect_list(F.col("x").cast("double")).alias("x"))


def filled(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, chunk, length of its trace, samples) of each row of ``chunks``."""
    places, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("w", "x"))
    edge = np.concatenate([[0], np.cumsum(batch.column("w").value_lengths().to_numpy())])
    for i, (c, n) in enumerate(zip(batch.column("c").to_pylist(), batch.column("size").to_pylist(), strict=True)):
        v = np.zeros(size)
        v[places[edge[i] : edge[i + 1]]] = values[edge[i] : edge[i + 1]]
        yield i, c, n, v


def repeated(batch: pa.RecordBatch, keys: list[str], counts: list[int]) -> list[pa.Array]:
    """The keys of each row, as often as the counts say."""
    at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
    return [batch.column(k).take(at) for k in keys]


def schema_of(df: DataFrame, keys: list[str], rest: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), rest])


def _per_chunk(size: int, hop: int) -> int:
    """Frames of a chunk: a few windows at least, so that borders are a small part."""
    return max(1, max(CHUNK, 4 * size) // hop)


def _rfft(batches: Iterable[pa.RecordBatch], keys: list[str], win: np.ndarray, hop: int, nfft: int, per: int) -> Iterator[pa.RecordBatch]:
    size = (per - 1) * hop + len(win)
    for batch in batches:
        first, found = [], []
        for _, c, n, v in filled(batch, size):
            many = min(per, (n - 1) // hop + 1 - c * per)
            first.append(c * per + np.arange(many))
            found.append(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(v, len(win))[: many * hop : hop] * win, nfft))
        if found:
            c = np.concatenate(found)
            offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
            cols = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part).ravel())) for part in (c.real, c.imag)]
            yield pa.RecordBatch.from_arrays([*repeated(batch, keys, list(map(len, first))), pa.array(np.concatenate(first)), *cols], names=[*keys, "m", "re", "im"])


def stft(traces: DataFrame, keys: list[str], size: int, hop: int, nfft: int | None = None, name: str | tuple = "hann", mode: str = "reflect") -> DataFrame:
    """(keys, k, m, re, im, amp) of the windowed frames, not normalised; frame m starts at m * hop - size // 2."""
    nfft, win, per = nfft or size, window(size, name), _per_chunk(size, hop)
    many = F.ceil(frame_count(F.col("_size"), hop) / per)
    cut = chunks(traces, keys, size // 2, (per - 1) * hop + size, per * hop, many, mode)
    wide = cut.mapInArrow(lambda it: _rfft(it, keys, win, hop, nfft, per), schema_of(traces, keys, "m long, re array<double>, im array<double>"))
    cells = wide.select(*keys, "m", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    return cells.select(*keys, F.col("k").cast("long"), "m", F.col("c.re").alias("re"), F.col("c.im").alias("im")).withColumn("amp", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))


def _irfft(batches: Iterable[pa.RecordBatch], keys: list[str], win: np.ndarray, hop: int, nfft: int, per: int) -> Iterator[pa.RecordBatch]:
    size, bins = (per - 1) * hop + len(win), nfft // 2 + 1
    at = np.arange(per)[:, None] * hop + np.arange(len(win))
    for batch in batches:
        m, k, re, im = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("m", "k", "re", "im"))
        edge = np.concatenate([[0], np.cumsum(batch.column("m").value_lengths().to_numpy())]).tolist()
        total, weight = np.zeros((batch.num_rows, size)), np.zeros((batch.num_rows, size))
        for i, (a, z) in enumerate(zip(edge, edge[1:], strict=False)):
            cells, there = np.zeros((per, bins), complex), np.zeros(per, bool)
            cells[m[a:z] % per, k[a:z]] = re[a:z] + 1j * im[a:z]
            there[m[a:z] % per] = True
            np.add.at(total[i], at[there], np.fft.irfft(cells[there], nfft)[:, : len(win)] * win)
            np.add.at(weight[i], at[there], np.broadcast_to(win**2, (there.sum(), len(win))))
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), batch.column("c"), *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (total, weight))], names=[*keys, "c", "v", "q"])


def istft(cells: DataFrame, keys: list[str], size: int, hop: int, nfft: int, length: int, name: str | tuple = "hann") -> DataFrame:
    """(keys, n, x) by weighted overlap-add of the frames' inverse transforms, for n below ``length``; bins without a cell are zero."""
    win, per = window(size, name), _per_chunk(size, hop)
    if not overlap_ok(win, hop):
        raise ValueError("the window and hop leave samples without weight")
    lists = [F.collect_list(F.col(c).cast(kind)).alias(c) for c, kind in (("m", "long"), ("k", "int"), ("re", "double"), ("im", "double"))]
    cut = cells.groupBy(*keys, F.floor(F.col("m") / per).alias("c")).agg(*lists)
    wide = cut.mapInArrow(lambda it: _irfft(it, keys, win, hop, nfft, per), schema_of(cells, keys, "c long, v array<double>, q array<double>"))
    rows = wide.select(*keys, "c", F.posexplode(F.arrays_zip("v", "q")).alias("w", "s"))
    n = F.col("c") * (per * hop) - size // 2 + F.col("w")
    inside = rows.select(*keys, n.alias("n"), F.col("s.v").alias("v"), F.col("s.q").alias("q")).where((F.col("n") >= 0) & (F.col("n") < length) & (F.col("q") > 0))
    return inside.groupBy(*keys, "n").agg((F.sum("v") / F.sum("q")).alias("x"))


def wavelet_frequencies(n: int, dt: float, voices: int = 8, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Descending Morlet centre frequencies, ``voices`` to an octave, from Nyquist down to a few cycles a trace."""
    top, least = 0.5 / dt, 4 / (n * dt)
    octaves = np.log2(top / least)
    f = top * 2.0 ** (-np.arange(int(octaves * voices) + 1) / voices)
    return f[(f >= (low or 0)) & (f <= (high or top))]


MORLET = 6.0


def _bank(n: int, dt: float, freqs: np.ndarray) -> np.ndarray:
    omega = 2 * np.pi * np.fft.fftfreq(n, dt)
    scale = MORLET / (2 * np.pi * freqs)
    x = scale[:, None] * omega[None, :]
    return np.where(omega > 0, 2 * np.exp(-0.5 * (x - MORLET) ** 2), 0)


def cwt(traces: DataFrame, keys: list[str], dt: float, voices: int = 8, low: float | None = None, high: float | None = None) -> DataFrame:
    """(keys, k, m, freq, re, im, amp): Morlet coefficients, one row for each frequency and sample; a task holds one trace."""
    kinds = {f.name: f.dataType.simpleString() for f in traces.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        x = table.sort_by("n").column("x").to_numpy()
        freqs = wavelet_frequencies(len(x), dt, voices, low, high)
        c = np.fft.ifft(np.fft.fft(x)[None, :] * _bank(len(x), dt, freqs), axis=1).ravel()
        k, m = np.divmod(np.arange(len(c)), len(x))
        head = {name: pa.array([table.column(name)[0].as_py()] * len(c), table.schema.field(name).type) for name in keys}
        return pa.table(head | {"k": k, "m": m, "freq": freqs[k], "re": c.real, "im": c.imag, "amp": np.abs(c)})

    return traces.select(*keys, "n", "x").groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "k long, m long, freq double, re double, im double, amp double"]))


def icwt(cells: DataFrame, keys: list[str], voices: int = 8) -> DataFrame:
    """(keys, n, x): the real parts summed over the frequencies; what lies outside them is lost."""
    # A log-spaced bank of one-sided Gaussians sums to voices * sqrt(2 pi) / (MORLET ln 2) at each frequency.
    gain = np.log(2) / voices * MORLET / np.sqrt(2 * np.pi)
    return cells.groupBy(*keys, F.col("m").alias("n")).agg((F.sum("re") * float(gain)).alias("x"))


def _filtered(traces: DataFrame, keys: list[str], change) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in traces.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        x = change(table.column("x").to_numpy())
        return pa.table({name: table.column(name) for name in (*keys, "n")} | {"x": x})

    return traces.select(*keys, "n", "x").groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, x double"]))


def bandpass(traces: DataFrame, keys: list[str], dt: float, low: float | None, high: float | None, order: int = 5) -> DataFrame:
    """(keys, n, x): zero-phase Butterworth filter, both ways, by its squared magnitude response on a mirrored trace."""

    def change(x: np.ndarray) -> np.ndarray:
        y = np.concatenate([x, x[::-1]])
        f = np.fft.rfftfreq(len(y), dt)
        warp = np.tan(np.pi * np.minimum(f, 0.5 / dt - 1e-12) * dt)
        gain = np.ones(len(f))
        if high:
            gain /= 1 + (warp / np.tan(np.pi * high * dt)) ** (2 * order)
        if low:
            with np.errstate(divide="ignore"):
                gain /= 1 + (np.tan(np.pi * low * dt) / warp) ** (2 * order)
        return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[: len(x)]

    return _filtered(traces, keys, change)


def envelope(traces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, x): magnitude of the analytic signal."""

    def change(x: np.ndarray) -> np.ndarray:
        h = np.zeros(len(x))
        h[0] = 1
        h[1 : (len(x) + 1) // 2] = 2
        if len(x) % 2 == 0:
            h[len(x) // 2] = 1
        return np.abs(np.fft.ifft(np.fft.fft(x) * h))

    return _filtered(traces, keys, change)


def decimate(traces: DataFrame, keys: list[str], factor: int, dt: float) -> DataFrame:
    """Every ``factor``-th sample after a low-pass at four fifths of the new Nyquist frequency."""
    smooth = bandpass(traces, keys, dt, None, 0.8 * 0.5 / (dt * factor), 8)
    return smooth.where(F.col("n") % factor == 0).withColumn("n", F.floor(F.col("n") / factor).cast("long"))


def detrend(traces: DataFrame, keys: list[str], kind: str = "linear") -> DataFrame:
    """(keys, n, x) without the mean or the regression line of each trace."""
    fit = traces.groupBy(*keys).agg(F.avg("x").alias("_c"), F.avg("n").alias("_n"), F.regr_slope("x", "n").alias("_s"))
    slope = F.coalesce("_s", F.lit(0.0)) if kind == "linear" else F.lit(0.0)
    return traces.join(fit, keys).withColumn("x", F.col("x") - F.col("_c") - slope * (F.col("n") - F.col("_n"))).drop("_c", "_n", "_s")


def sparse_gabor(traces: DataFrame, keys: list[str], size: int, hop: int, penalty: float, rounds: int = 30, tolerance: float = 0.0, debias: int = 0) -> DataFrame:
    """(keys, n, x): the trace from few coefficients, by accelerated soft thresholding on a tight frame; a task holds one trace.

    Rounds end early once the coefficients move by less than ``tolerance`` of
    their norm. ``debias`` is the number of conjugate-gradient steps that then
    fit the coefficients that are left to the trace by least squares, without
    the penalty.
    """
    win = window(size)
    rate = np.sqrt((win**2).reshape(-1, hop).sum(axis=0)) if size % hop == 0 else None
    if rate is None:
        raise ValueError("the hop must divide the window")
    tight = win / np.tile(rate, size // hop)

    def change(x: np.ndarray) -> np.ndarray:
        n, lead = len(x), size - hop
        total = -(-(n + 2 * lead) // hop) * hop + size
        at = np.arange(0, total - size + 1, hop)[:, None] + np.arange(size)
        pad = np.zeros(total)
        pad[lead : lead + n] = x
        fwd = lambda y: np.fft.rfft(y[at] * tight, norm="ortho")

        def back(c: np.ndarray) -> np.ndarray:
            out = np.zeros(total)
            np.add.at(out, at, np.fft.irfft(c, size, norm="ortho") * tight)
            return out

        c = z = np.zeros((len(at), size // 2 + 1), complex)
        t = 1.0
        for _ in range(rounds):
            g = z + fwd(pad - back(z))
            mag = np.abs(g)
            new = g * np.maximum(0, 1 - penalty / np.maximum(mag, 1e-300))
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            moved = np.linalg.norm(new - c)
            z, c, t = new + (t - 1) / t2 * (new - c), new, t2
            if moved <= tolerance * np.linalg.norm(c):
                break
        support = c != 0
        r = np.where(support, fwd(pad - back(c)), 0)
        p, left = r, np.vdot(r, r).real
        for _ in range(debias):
            if left <= 1e-24 * max(1.0, np.vdot(c, c).real):
                break
            q = np.where(support, fwd(back(p)), 0)
            step = left / np.vdot(p, q).real
            c, r = c + step * p, r - step * q
            before, left = left, np.vdot(r, r).real
            p = r + left / before * p
        return back(c)[lead : lead + n]

    return _filtered(traces, keys, change)
