"""Parameters in seconds and hertz, and the counts they mean."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Spectral:
    """A detector's or denoiser's parameters; the counts derive from them."""

    dt: float
    window_s: float
    overlap: float = 0.75
    nfft: int | None = None
    rho: float | None = 8.0
    big_rho: float = 4.0
    least_fraction: float = 0.25
    frame_s: float | None = None
    min_frame: int = 250
    group_hz: float | None = None
    band_hz: tuple[float, float] | None = None
    size_s: float = 0.0
    size_hz: float = 0.0
    gap_s: float | None = None
    gap_hz: float | None = None
    min_traces: int = 1
    background: float = 0.0

    def __post_init__(self):
        if not 0 <= self.overlap < 1 or self.dt <= 0 or self.window_s <= 0:
            raise ValueError("dt and window must be positive, the overlap in [0, 1)")
        if self.band_hz and self.band_hz[1] - self.band_hz[0] < self.size_hz:
            raise ValueError("the band is narrower than the least cluster")

    @property
    def window(self) -> int:
        return max(1, round(self.window_s / self.dt))

    @property
    def hop(self) -> int:
        return self.window - int(self.overlap * self.window)

    @property
    def fft(self) -> int:
        n = self.window if self.nfft is None else 1 << (self.window - 1).bit_length() if self.nfft < 0 else max(self.nfft, self.window)
        return n + n % 2

    @property
    def bins(self) -> int:
        return self.fft // 2 + 1

    @property
    def df(self) -> float:
        return 1 / self.dt / self.fft

    @property
    def edge(self) -> int:
        return self.window // 2 // self.hop

    @property
    def frame(self) -> int:
        return max(round(self.frame_s / (self.hop * self.dt)) if self.frame_s else 0, self.min_frame)

    @property
    def band(self) -> tuple[int, int] | None:
        return (round(self.band_hz[0] / self.df), round(self.band_hz[1] / self.df) + 1) if self.band_hz else None

    def count(self, value: float | None, step: float) -> int:
        return max(round(value / step), 1) if value else 1

    @property
    def sizes(self) -> tuple[int, int]:
        """Least extent of a cluster in bins and frames."""
        return self.count(self.size_hz, self.df), self.count(self.size_s, self.hop * self.dt)

    @property
    def gaps(self) -> tuple[int, int]:
        """Distance of neighbours in bins and frames."""
        return self.count(self.gap_hz, self.df), self.count(self.gap_s, self.hop * self.dt)

    def with_step(self, dt: float) -> Spectral:
        """The same parameters for data of another sampling step."""
        return replace(self, dt=dt)

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Spectral:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


#: Hourly traces of the event stream, with parameters that leave results at every scale.
HOURLY = Spectral(dt=3600.0, window_s=24 * 3600.0, nfft=32, rho=4.0)
#: Named sets for the synthetic traces.
PRESETS = {
    "basic": Spectral(dt=0.005, window_s=0.5, overlap=0.8, rho=5.5, frame_s=200, size_s=0.2, size_hz=10, gap_s=0.2, gap_hz=2),
    "components": Spectral(dt=0.005, window_s=1.0, overlap=0.8, rho=6.0, frame_s=200, size_s=0.2, size_hz=8, gap_s=0.2, gap_hz=2),
    "traces": Spectral(dt=0.005, window_s=1.0, overlap=0.8, rho=6.5, frame_s=1000, size_s=0.2, size_hz=10, gap_s=0.2, gap_hz=2, min_traces=3),
    "denoise": Spectral(dt=0.005, window_s=1.0, overlap=0.9, rho=6.0, frame_s=200, band_hz=(0, 30), size_s=0.2, size_hz=8, gap_s=0.2, gap_hz=2),
}
