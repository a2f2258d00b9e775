"""Features of windows, made from panes so that overlapping windows don't copy their frames.

A file is cut into cells of ``CELL`` frames; a cell also gets the frames that its last windows
reach into, so a frame goes to one cell or two (more only where windows are longer than cells). Inside a
cell frames are reduced once to panes of gcd(size, stride) frames, and every window is merged from
two parts: the panes up to the end of its block and those from the next block's start.

Frames without a number, without bins or with a null bin take no part; a window is complete if
each of its numbers is there once. All frames of a table have equally many bins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wavesift.functions.rows import matrix, whole

#: Frames of a file that are put in order together, and values of the features that one batch holds.
CELL = 1 << 12
VALUES = 1 << 21


def _given(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("frame").isNotNull() & whole("bins"))


def _panes(x: np.ndarray, size: int) -> np.ndarray:
    """Sums of runs of ``size`` frames."""
    return np.add.reduceat(x, np.arange(0, len(x), size), axis=0)


def _of_panes(x: np.ndarray, size: int, stride: int) -> tuple[int, np.ndarray]:
    """Frames of a pane, and the frames without what would be a part of one; windows begin and end with panes."""
    pane = math.gcd(size, stride)
    return pane, x[: len(x) // pane * pane]


def _scanned(parts: list[np.ndarray], block: int, merge: Callable, back: bool) -> list[np.ndarray]:
    """Each pane merged with those before it in its block, or behind it."""
    n = len(parts[0])
    rows = -(-n // block)
    full = [np.concatenate([p, np.zeros((rows * block - n, *p.shape[1:]))]).reshape(rows, block, *p.shape[1:]) for p in parts]
    steps = range(block - 2, -1, -1) if back else range(1, block)
    for i in steps:
        one, rest = [p[:, i] for p in full], [p[:, i + 1 if back else i - 1] for p in full]
        for p, now in zip(full, merge(one, rest) if back else merge(rest, one)):
            p[:, i] = now
    return [p.reshape(rows * block, *p.shape[2:])[:n] for p in full]


def merged_windows(parts: list[np.ndarray], size: int, merge: Callable) -> list[np.ndarray]:
    """All windows of ``size`` neighbouring panes, each merged from two scans; parts have a row for each pane.

    Nothing is ever taken away again, so no digits are lost where loud frames leave a window.
    """
    n = len(parts[0]) - size + 1
    if n <= 0:
        return [p[:0] for p in parts]
    if size == 1:
        return parts
    ahead, behind = _scanned(parts, size, merge, True), _scanned(parts, size, merge, False)
    start = np.arange(n)
    joined = merge([p[:n] for p in ahead], [p[start + size - 1] for p in behind])
    # a window that begins a block is that block's scan alone
    alone = (start % size == 0).reshape(-1, *[1] * (parts[0].ndim - 1))
    return [np.where(alone.reshape(-1, *[1] * (p.ndim - 1)), p[:n], j) for p, j in zip(ahead, joined)]


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _moments(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Count, mean and squares around it of two parts together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    off = b[1] - a[1]
    return [n, a[1] + off * share, a[2] + b[2] + off * off * a[0] * share]


def _mean_std(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    pane, x = _of_panes(x, size, stride)
    count = _panes(np.ones((len(x), 1)), pane)
    mean = _panes(x, pane) / count
    squares = _panes((x - np.repeat(mean, count[:, 0].astype(int), 0)) ** 2, pane)
    n, mean, squares = merged_windows([count, mean, squares], size // pane, _moments)
    return np.concatenate([mean, np.sqrt(squares / n)], 1)[:: stride // pane]


def _ratio(change: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum of changes by the total; 0 where the total is not above 0."""
    return np.divide(change, total, out=np.zeros_like(total), where=total > 0)


def _aci(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Changes between frames: inside the panes, and from each pane to the next one, but not into the window."""
    pane, x = _of_panes(x, size, stride)
    moved = np.abs(np.diff(x, axis=0, prepend=x[:1]))
    into = moved[::pane].copy()
    moved[::pane] = 0
    merge = lambda a, b: [a[0] + b[2] + b[0], a[1] + b[1], a[2]]
    change, total, _ = merged_windows([_panes(moved, pane), _panes(x, pane), into], size // pane, merge)
    return _ratio(change, total)[:: stride // pane]


def _aci_time(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    each = _ratio(np.abs(np.diff(x, axis=1)).sum(1), x.sum(1))
    return np.lib.stride_tricks.sliding_window_view(each, size)[::stride]


def _aci_both(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    return np.concatenate([_aci(x, size, stride), _aci_time(x, size, stride)], 1)


def _full(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """All values of a window, bin by bin; a view, so that it is copied by slices only."""
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=0)[::stride]


METHODS: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {"mean_std": _mean_std, "ACI": _aci, "ACI_time": _aci_time, "ACI_both": _aci_both, "full_window": _full}


def build(frames: DataFrame, size: int, stride: int, method: str | Callable[[np.ndarray, int, int], np.ndarray] = "mean_std") -> DataFrame:
    """file, start_frame and features of every complete window.

    A method is one by name, or a function of (time, bins), size and stride that gives each window's values.
    """
    if not callable(method) and method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    function, width = method if callable(method) else METHODS[method], max(CELL // stride, 1) * stride
    cells = F.sequence(F.greatest(F.lit(0).cast("long"), F.expr(f"(frame - {size - 1}) div {width}")), F.expr(f"frame div {width}"))
    spread = _given(frames).where("frame >= 0").select("file", "frame", F.col("bins").cast("array<double>").alias("bins"), F.explode(cells).alias("cell"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame").combine_chunks()
        number = rows.column("frame").to_numpy()
        x = matrix(rows.column("bins").combine_chunks())
        batches = []
        # runs of numbers without a gap, and without a number that comes again
        alone = np.append(number[1:] != number[:-1], True) & np.insert(number[1:] != number[:-1], 0, True)
        number, x = number[alone], x[alone]
        cell = key[1].as_py()
        for lo, hi in _runs(number):
            first = -(-number[lo] // stride) * stride
            # the cell's own windows begin below its end; the next cell makes the others
            stop = min(number[hi - 1] + 1, (cell + 1) * width - 1 + size)
            first = max(first, cell * width)
            if stop - first < size:
                continue
            part = x[lo + first - number[lo] : lo + stop - number[lo]]
            got = function(part, size, stride)
            start = first + stride * np.arange(len(got))
            step = max(1, VALUES // max(1, math.prod(got.shape[1:])))
            for at in range(0, len(got), step):
                some = np.ascontiguousarray(got[at : at + step]).reshape(len(start[at : at + step]), -1)
                ends = np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]
                batches.append(pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(some), kind), pa.array(start[at : at + step]), pa.ListArray.from_arrays(pa.array(ends), pa.array(some.ravel()))], schema=made))
        return pa.Table.from_batches(batches, made)

    kind = to_arrow_type(frames.schema["file"].dataType)
    made = pa.schema([("file", kind), ("start_frame", pa.int64()), ("features", pa.list_(pa.float64()))])
    schema = T.StructType([T.StructField("file", frames.schema["file"].dataType), T.StructField("start_frame", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return spread.groupBy("file", "cell").applyInArrow(run, schema)


def _runs(number: np.ndarray) -> list[tuple[int, int]]:
    """First and end position of each run of neighbouring numbers."""
    cut = np.flatnonzero(np.diff(number) != 1) + 1
    return [(lo, hi) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(number)]) if hi > lo]


def mean_std(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Mean and population standard deviation of every bin, one after the other."""
    return build(frames, size, stride, "mean_std")


def aci(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Acoustic complexity of every bin: differences between frames by the total."""
    return build(frames, size, stride, "ACI")


def aci_time(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Acoustic complexity of every frame: differences between bins by the total."""
    return build(frames, size, stride, "ACI_time")


def full_window(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """All values of a window, bin by bin."""
    return build(frames, size, stride, "full_window")


def by_file(frames: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of every bin over whole files."""
    got = _given(frames).groupBy("file").agg(Summarizer.metrics("mean", "std").summary(array_to_vector("bins")).alias("s"))
    return got.select("file", F.concat(vector_to_array("s.mean"), vector_to_array("s.std")).alias("features"))


def long_form(features: DataFrame, *keys: str) -> DataFrame:
    """One row for each dimension: keys, dim (from 0), value."""
    return features.select(*keys, F.posexplode("features").alias("dim", "value"))


def resized(arrays: DataFrame, column: str, length: int) -> DataFrame:
    """Arrays of one length: longer ones thinned evenly, shorter ones padded with zeros."""
    c, size = F.col(column), F.size(column)
    thin = lambda k: F.get(c, F.floor(k * size / F.lit(length)).cast("int"))
    pad = lambda k: F.coalesce(F.get(c, k), F.lit(0.0))
    return arrays.withColumn(column, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.when(size > length, thin(k)).otherwise(pad(k))))
