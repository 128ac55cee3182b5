"""Constants of the noise model and the divisions of axes, computed on the driver."""

from __future__ import annotations

import math
from functools import lru_cache


def spread(d: int) -> float:
    """Mean norm of a d-dimensional standard normal vector."""
    return math.sqrt(2) * math.gamma((d + 1) / 2) / math.gamma(d / 2)


def _log_hyp0f1(b: float, z: float) -> float:
    """Logarithm of 0F1(b; z) for z >= 0 by its series, terms kept by logarithm."""
    term, terms, k = 0.0, [0.0], 0
    while k < 20_000:
        term += math.log(z) - math.log((b + k) * (k + 1)) if z > 0 else -math.inf
        terms.append(term)
        k += 1
        if term < max(terms) - 40:
            break
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


@lru_cache(maxsize=256)
def threshold(d: int, rho: float) -> float:
    """The xi with 0F1(d/2; rho^2 xi^2 / 4) = exp(rho^2 / 2), by bisection."""
    lo, hi = 0.0, rho + 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if _log_hyp0f1(d / 2, (rho * mid) ** 2 / 4) < rho * rho / 2:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def ratio_of(d: int, rho: float) -> float:
    """The threshold in units of the mean norm."""
    return threshold(d, rho) / spread(d)


def least_snr(n: float, d: int) -> float:
    """The signal-to-noise ratio taken when none is given."""
    return math.sqrt(2 * math.log(n * d))


def least_count(length: int, fraction: float | None = None, level: float = 0.95) -> int:
    """Order statistics below which noise is not looked for: a fraction of the block, or Chebyshev's bound."""
    if fraction is not None:
        return int(fraction * length)
    return max(1, int(length / 2 - math.sqrt(length / (4 * (1 - level)))))


def level_of(length: int, count: int) -> float:
    """The level at which ``least_count`` gives ``count``."""
    return 1 - length / (4 * (length / 2 - count) ** 2)


def divide(n: int, length: int) -> list[tuple[int, int]]:
    """Inclusive intervals of ``length`` over 0 .. n - 1; the last one takes the remainder."""
    many = max(1, n // max(1, length))
    return [(i * length, (i + 1) * length - 1 if i < many - 1 else n - 1) for i in range(many)]


def divide_log(n: int, step: float, base: float = 2.0) -> list[tuple[int, int]]:
    """Inclusive intervals whose lengths grow as powers of the base."""
    out, at, k = [], 0, 0
    while at < n:
        end = min(n, at + max(1, round(base ** (k * step))))
        out.append((at, end - 1))
        at, k = end, k + 1
    return out


def bin_groups(nf: int, width: int, log: bool = False) -> list[tuple[int, int]]:
    """Groups of frequency bins; the first and the last bin stand alone."""
    inner = divide_log(nf - 2, width) if log else divide(nf - 2, width)
    return [(0, 0), *[(a + 1, b + 1) for a, b in inner], (nf - 1, nf - 1)]


def group_hertz(groups: list[tuple[int, int]], df: float) -> list[tuple[float, float]]:
    """The groups' first and last frequencies."""
    return [(a * df, b * df) for a, b in groups]


def in_band(groups: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Groups that overlap the bins low .. high."""
    return [(a, b) for a, b in groups if a <= high and b >= low]
