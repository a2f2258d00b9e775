"""Spectrograms of samples in tables and of recordings in chunks, filters, and resampling."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FLOOR = 1e-10
#: Samples of a series that are put in order together.
CELL = 1 << 16

#: Window functions by name: weights of the n samples of a frame, periodic.
WINDOWS = {
    "hann": lambda n: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n),
    "hamming": lambda n: 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n),
    "blackman": lambda n: 0.42 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) + 0.08 * np.cos(4 * np.pi * np.arange(n) / n),
    "ones": np.ones,
}


def decibels(power: Column, reference: float = 1e-6) -> Column:
    """10 log10 of the power by the squared reference level, floored."""
    return 10 * F.log10(F.greatest(power / F.lit(reference**2), F.lit(FLOOR)))


def stft_power(samples: DataFrame, n_fft: int = 16, hop: int = 8) -> DataFrame:
    """file, frame and power of the bins: Hann window, not centred, complete frames only.

    A series is cut into cells of about ``CELL`` samples; a cell also gets the samples that its last frames
    reach into, so hardly any sample is copied, and no series is the work of one task. Samples without a place or an
    amplitude take no part, and a frame needs each of its places once.
    """
    if n_fft % hop:
        raise ValueError("n_fft must be a multiple of hop")
    width = max(CELL // hop, 1) * hop
    cells = F.sequence(F.greatest(F.lit(0).cast("long"), F.expr(f"(n - {n_fft - 1}) div {width}")), F.expr(f"n div {width}"))
    given = samples.where(F.col("n").isNotNull() & (F.col("n") >= 0) & F.col("amplitude").isNotNull())
    spread = given.select("file", "n", F.col("amplitude").cast("double").alias("amplitude"), F.explode(cells).alias("cell"))
    shape = WINDOWS["hann"](n_fft)
    kind = to_arrow_type(samples.schema["file"].dataType)
    made = pa.schema([("file", kind), ("frame", pa.int64()), ("power", pa.list_(pa.float64()))])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        n, x = rows.column("n").to_numpy(), rows.column("amplitude").to_numpy()
        alone = np.append(n[1:] != n[:-1], True) & np.insert(n[1:] != n[:-1], 0, True)
        n, x = n[alone], x[alone]
        cell = key[1].as_py()
        cut = np.flatnonzero(np.diff(n) != 1) + 1
        batches = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(n)]):
            if hi - lo < n_fft:
                continue
            # the cell's own frames begin below its end; the next cell makes the others
            first = max(-(-int(n[lo]) // hop), cell * width // hop)
            last = min((int(n[hi - 1]) + 1 - n_fft) // hop, ((cell + 1) * width - 1) // hop)
            for at in range(first, last + 1, 1024):
                frame = np.arange(at, min(at + 1024, last + 1))
                power = np.abs(np.fft.rfft(x[(frame * hop - n[lo])[:, None] + np.arange(n_fft)] * shape, axis=1)) ** 2
                ends = np.arange(len(frame) + 1, dtype=np.int32) * power.shape[1]
                batches.append(pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(frame), kind), pa.array(frame), pa.ListArray.from_arrays(pa.array(ends), pa.array(power.ravel()))], schema=made))
        return pa.Table.from_batches(batches, made)

    schema = T.StructType([T.StructField("file", samples.schema["file"].dataType), T.StructField("frame", T.LongType()), T.StructField("power", T.ArrayType(T.DoubleType()))])
    return spread.groupBy("file", "cell").applyInArrow(run, schema)


def mel_weights(n_freqs: int, n_mels: int, sample_rate: float, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    """Triangular filters (n_mels, n_freqs), equally spaced in mel = 2595 log10(1 + f / 700)."""
    f_max = sample_rate / 2 if f_max is None else f_max
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(f_min), mel(f_max), n_mels + 2) / 2595) - 1)
    freqs = np.linspace(0, sample_rate / 2, n_freqs)
    up = (freqs[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_power(frames: DataFrame, weights: np.ndarray) -> DataFrame:
    """power of every frame through the filters; weights are a small fixed matrix."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    dot = lambda row: F.aggregate(F.zip_with("power", row, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return frames.withColumn("power", F.transform(rows, dot))


def resampled_length(n: int, rate: int, target: int) -> int:
    return max(1, -(-n * target // rate))


@lru_cache(16)
def _phases(rate: int, target: int, width: int) -> tuple[int, int, int, np.ndarray]:
    """Steps of the input and of the output in a period, the first tap's place, and the taps of each phase.

    Both rates divided by their common divisor, sample m of the result lies phase / up behind
    sample m * down // up of the signal; so there are ``up`` phases, and their weights are made once.
    """
    common = math.gcd(rate, target)
    down, up = rate // common, target // common
    cut = min(1.0, target / rate)
    first = -int(width / cut)
    away = (np.arange(up) / up)[:, None] - np.arange(first, int(width / cut) + 2)
    taps = cut * np.sinc(cut * away) * np.where(np.abs(away) * cut < width, np.cos(np.pi * away * cut / (2 * width)) ** 2, 0)
    return down, up, first, taps


def resampled_span(first: int, last: int, rate: int, target: int, width: int = 16) -> tuple[int, int]:
    """Samples of a signal that samples ``first`` to ``last`` of its resampled form depend on."""
    if rate == target:
        return first, last
    down, up, at, taps = _phases(rate, target, width)
    return first * down // up + at, (last - 1) * down // up + at + taps.shape[1]


def resampled(x: np.ndarray, rate: int, target: int, first: int = 0, last: int | None = None, width: int = 16, begin: int = 0, length: int | None = None) -> np.ndarray:
    """Windowed-sinc resampling by a bank of phases: samples ``first`` to ``last`` of the result.

    ``x`` is the signal, or its samples from ``begin`` on where the whole has ``length``. Any span is
    the same as when all is made at once, so a recording can be cut anywhere.
    """
    length = len(x) if length is None else length
    last = resampled_length(length, rate, target) if last is None else last
    if rate == target:
        return x if first == begin and last == begin + len(x) else x[first - begin : last - begin]
    down, up, at, taps = _phases(rate, target, width)
    lo, hi = resampled_span(first, last, rate, target, width)
    # zeros around the signal, and x where the span has it
    part = np.zeros(max(0, hi - lo))
    inner = slice(max(lo, begin, 0), max(min(hi, begin + len(x), length), max(lo, begin, 0)))
    part[inner.start - lo : inner.stop - lo] = x[inner.start - begin : inner.stop - begin]
    out = np.zeros(max(0, last - first), np.float32)
    for m in range(first, min(first + up, last)):
        # samples m, m + up, ... are of one phase and step ``down`` samples of the signal
        rows = -(-(last - m) // up)
        begin_at = m * down // up + at - lo
        seen = np.lib.stride_tricks.as_strided(part[begin_at:], (rows, taps.shape[1]), (down * part.itemsize, part.itemsize), writeable=False)
        out[m - first :: up] = seen @ taps[m * down % up]
    return out


def spectrogram(chunks: DataFrame, n_fft: int = 1024, hop: int = 512, weights: np.ndarray | None = None, reference: float = 1e-6, window: str = "hann", errors: bool = False) -> DataFrame:
    """file, frame and bins in dB of chunks, centred frames with reflected ends.

    With ``errors`` also sr and error, and one row for each recording that gave no frames.

    ``chunks`` come from ``wav.chunks`` with ``overlap=n_fft``. A frame is made by the one
    chunk that holds its first sample (of the reflected signal the first chunk), so
    every frame is made once.
    """
    half = n_fft // 2
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window}; one of {', '.join(WINDOWS)}")
    shape = WINDOWS[window](n_fft)

    def run(batches):
        for pdf in batches:
            for file, rate, length, first, x, error in zip(pdf["file"], pdf["sr"], pdf["length"], pdf["first"], pdf["samples"], pdf["error"], strict=True):
                if x is None or length <= half:
                    if errors:
                        yield pd.DataFrame({"file": [file], "sr": [rate], "frame": [None], "bins": [None], "error": [error or f"{int(length)} samples are too few to reflect"]})
                    continue
                x, length = np.asarray(x, np.float64), int(length)
                begin, last = int(first), first + len(x) >= length
                size = len(x) if last else len(x) - n_fft
                lo = 0 if begin == 0 else -(-(begin + half) // hop)
                hi = length // hop if last else (begin + size + half - 1) // hop
                if begin == 0:
                    x = np.concatenate([x[1 : half + 1][::-1], x])
                    begin -= half
                if last:
                    x = np.concatenate([x, x[-half - 1 : -1][::-1]])
                frames = np.arange(lo, hi + 1)
                starts = frames * hop - half - begin
                for at in range(0, len(starts), 512):
                    part = np.stack([x[s : s + n_fft] for s in starts[at : at + 512]]) * shape
                    power = np.abs(np.fft.rfft(part, axis=1)) ** 2
                    if weights is not None:
                        power = power @ weights.T
                    db = 10 * np.log10(np.maximum(power / reference**2, FLOOR))
                    out = pd.DataFrame({"file": file, "frame": frames[at : at + 512], "bins": list(db)})
                    yield out.assign(sr=int(rate), error=None)[["file", "sr", "frame", "bins", "error"]] if errors else out

    return chunks.mapInPandas(run, "file string, sr int, frame long, bins array<double>, error string" if errors else "file string, frame long, bins array<double>")
