"""Settings of the pipeline, shared by all stages."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: First bin and the one behind the last, by the number of mel bins (fixed values).
MEL_BANDS = {None: (0, None), 128: (9, 128)}


@dataclass(frozen=True)
class Settings:
    """One set of parameters, so that extraction and analysis cannot disagree."""

    sample_rate: int = 64_000
    n_fft: int = 1024
    hop: int = 512
    window: str = "hann"
    resample_rate: int | None = None
    n_mels: int | None = None
    f_min: float = 0.0
    f_max: float | None = None
    reference: float = 1e-6
    start_secs: float = 5.0
    end_secs: float | None = 265.0
    window_secs: float = 5.0
    stride_secs: float | None = None
    band_start: int = 9
    band_end: int | None = None
    method: str = "mean_std"
    n_components: int = 20
    metric: str = "mahalanobis"
    percentile: float = 95.0
    tolerance: float = 5.0

    @property
    def secs_per_frame(self) -> float:
        return self.hop / (self.resample_rate or self.sample_rate)

    def frames(self, secs: float) -> int:
        """Seconds to frames, half to even, one at least."""
        return max(1, round(secs / self.secs_per_frame))

    @property
    def window_frames(self) -> int:
        return self.frames(self.window_secs)

    @property
    def stride_frames(self) -> int:
        return self.frames(self.window_secs if self.stride_secs is None else self.stride_secs)

    def with_mels(self, n_mels: int | None) -> Settings:
        """The same with a number of mel bins and the band that goes with it; without a preset the band stays."""
        start, end = MEL_BANDS.get(n_mels, (self.band_start, self.band_end))
        return replace(self, n_mels=n_mels, band_start=start, band_end=end)
