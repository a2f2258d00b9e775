"""Pictures of all scores and of windows, made as aggregates: pixels of a scatter, pooled tiles of spectrograms.

A scatter never collects points: Spark counts them by pixel, and the driver gets at most one row for each. A window
becomes a tile of pooled values in the task that builds it; tiles of a file are laid out in pages
of bounded size, a task each. Rows with null scores or fewer than two components are in no scatter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.functions import png
from wavesift.functions.order import placed
from wavesift.functions.rows import whole
from wavesift.operators import features

WIDTH, HEIGHT = 640, 480
#: Files that a legend names at most (fixed value).
LEGEND = 20
#: Rows and columns of a tile, and tiles of a page.
TILE_ROWS, TILE_COLUMNS, PAGE = 64, 96, 200
MARGIN, LINE = 24, 8


def bounds(rows: DataFrame, x: Column, y: Column) -> tuple[float, float, float, float] | None:
    """Least and greatest of both coordinates."""
    r = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return None if r is None or r[0] is None else tuple(r)


def pixels(rows: DataFrame, x: Column, y: Column, box: tuple[float, float, float, float], width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Add px and py, the pixel of a point; row 0 is the lowest, and the greatest value lies in the last one."""
    of = lambda v, lo, hi, n: F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * n), F.lit(n - 1)).cast("int") if hi > lo else F.lit(n // 2)
    return rows.withColumns({"px": of(x, box[0], box[1], width), "py": of(y, box[2], box[3], height)})


def _dots(image: np.ndarray, px: np.ndarray, py: np.ndarray, colours: np.ndarray, radius: int = 1) -> None:
    """Squares around points, in the order given."""
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            image[image.shape[0] - 1 - MARGIN - py + dy, MARGIN + px + dx] = colours


def _frame(explained: np.ndarray, box, title: str) -> np.ndarray:
    image = png.blank(HEIGHT + 2 * MARGIN, WIDTH + 2 * MARGIN)
    top, left, bottom, right = MARGIN - 3, MARGIN - 3, HEIGHT + MARGIN + 2, WIDTH + MARGIN + 2
    image[[top, bottom], left : right + 1] = image[top : bottom + 1, [left, right]] = (120, 120, 120)
    share = [f"{100 * x:.1f}%" for x in [*explained, 0.0, 0.0][:2]]
    png.write(image, 4, left, title)
    png.write(image, bottom + 4, left, f"PC1 ({share[0]}) {box[0]:.2f} : {box[1]:.2f}   PC2 ({share[1]}) {box[2]:.2f} : {box[3]:.2f}")
    return image


def _points(scores: DataFrame) -> tuple[DataFrame, Column, Column]:
    given = scores.where(whole("scores"))
    one = given.select(F.size("scores")).first()
    if one is not None and one[0] < 2:
        raise ValueError("a scatter needs two components")
    return given, F.get("scores", F.lit(0)), F.get("scores", F.lit(1))


def by_file(scores: DataFrame, explained: np.ndarray) -> bytes:
    """All windows, coloured by file; a pixel shows the file with most windows in it. Up to LEGEND files are named."""
    given, x, y = _points(scores)
    box = bounds(given, x, y)
    if box is None:
        return png.encode(_frame(explained, (0, 0, 0, 0), "no windows"))
    names = [r[0] for r in given.select(F.col("file").cast("string").alias("file")).distinct().orderBy("file").limit(LEGEND + 1).collect()]
    seen = pixels(given.withColumn("file", F.col("file").cast("string")), x, y, box).groupBy("px", "py", "file").agg(F.count("*").alias("n"))
    top = seen.groupBy("px", "py").agg(F.min_by("file", F.struct(-F.col("n"), "file")).alias("file"))
    rows = top.select("px", "py", "file", F.pmod(F.xxhash64("file"), F.lit(997)).alias("h")).toPandas()
    named = len(names) <= LEGEND
    place = {name: i / max(1, len(names)) for i, name in enumerate(names)}
    share = rows["file"].map(place).to_numpy(float) if named else rows["h"].to_numpy() / 997
    image = _frame(explained, box, "windows by file")
    _dots(image, rows["px"].to_numpy(), rows["py"].to_numpy(), png.hue(share))
    if named:
        for i, name in enumerate(names):
            image[MARGIN + LINE * i : MARGIN + LINE * i + 5, MARGIN + 2 : MARGIN + 7] = png.hue(np.array([place[name]]))[0]
            png.write(image, MARGIN + LINE * i, MARGIN + 10, str(name))
    return png.encode(image)


def by_window(scores: DataFrame, explained: np.ndarray) -> bytes:
    """The windows of one file, coloured by their start; a pixel shows the last one in it."""
    given, x, y = _points(scores)
    box = bounds(given, x, y)
    if box is None:
        return png.encode(_frame(explained, (0, 0, 0, 0), "no windows"))
    rows = pixels(given, x, y, box).groupBy("px", "py").agg(F.max("start_frame").alias("start")).toPandas()
    image = _frame(explained, box, "windows by time")
    _dots(image, rows["px"].to_numpy(), rows["py"].to_numpy(), png.scaled(rows["start"].to_numpy(float)))
    return png.encode(image)


def with_outliers(scores: DataFrame, found: DataFrame, explained: np.ndarray) -> bytes:
    """All windows green, outliers red on top of them, and a star at the mean."""
    given, x, y = _points(scores)
    box = bounds(given, x, y)
    if box is None:
        return png.encode(_frame(explained, (0, 0, 0, 0), "no windows"))
    marked = found.select(F.col("file").alias("__file"), F.col("start_frame").alias("__start"), F.lit(True).alias("__out")).distinct()
    both = given.join(marked, F.col("file").eqNullSafe(F.col("__file")) & (F.col("start_frame") == F.col("__start")), "left")
    rows = pixels(both, x, y, box).groupBy("px", "py").agg(F.max(F.coalesce("__out", F.lit(False))).alias("out")).orderBy("out").toPandas()
    image = _frame(explained, box, "outliers")
    _dots(image, rows["px"].to_numpy(), rows["py"].to_numpy(), np.where(rows["out"].to_numpy(bool)[:, None], (210, 30, 30), (60, 160, 70)).astype(np.uint8))
    mean = pixels(given.agg(F.avg(x).alias("a"), F.avg(y).alias("b")), F.col("a"), F.col("b"), box).first()
    for step in range(-6, 7):
        for dy, dx in ((step, 0), (0, step), (step, step), (step, -step)):
            at = np.array([np.clip(mean["px"] + dx, 0, WIDTH - 1)]), np.array([np.clip(mean["py"] + dy, 0, HEIGHT - 1)])
            _dots(image, *at, np.array([[20, 20, 20]], np.uint8), 0)
    return png.encode(image)


def _edges(n: int, parts: int) -> np.ndarray:
    return np.arange(min(n, parts)) * n // min(n, parts)


def tile(x: np.ndarray, size: int, stride: int, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> np.ndarray:
    """Greatest values of windows of (time, bins) by (rows, columns), lowest bins first."""
    pooled = np.maximum.reduceat(x, _edges(x.shape[1], rows), axis=1)
    view = np.lib.stride_tricks.sliding_window_view(pooled, size, axis=0)[::stride]
    step = max(1, features.VALUES // (pooled.shape[1] * size))
    parts = [np.maximum.reduceat(view[at : at + step], _edges(size, columns), axis=2) for at in range(0, len(view), step)]
    return np.concatenate(parts) if parts else np.empty((0, pooled.shape[1], min(size, columns)))


def tiles(frames: DataFrame, size: int, stride: int, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """file, start_frame and tile (row by row) of every complete window."""
    return features.build(frames, size, stride, lambda x, a, b: tile(x, a, b, rows, columns)).withColumnRenamed("features", "tile")


def grids(windows: DataFrame, size: int, secs_per_frame: float, across: int = 2, scale: str = "dusk", columns: int = TILE_COLUMNS, page: int = PAGE) -> DataFrame:
    """name and content of pictures of each file's tiles (file, start_frame, tile), by start, ``across`` in a row.

    A file has as many pictures as pages: its stem, with the page's number behind it from the second on.
    """
    width = min(size, columns)
    numbered = placed(windows.select("file", "start_frame", "tile"), "file", ["start_frame"], F.expr(f"start_frame div {features.CELL}"), "__nth")
    paged = numbered.withColumn("__page", F.floor(F.col("__nth") / page))

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_frame", kind="stable")
        file, nth = str(pdf["file"].iloc[0]), int(pdf["__page"].iloc[0])
        shapes = [np.asarray(t, float).reshape(-1, width)[::-1] for t in pdf["tile"]]
        height = max(len(s) for s in shapes)
        lines = math.ceil(len(shapes) / across)
        image = png.blank(LINE + 4 + lines * (height + LINE + 4), 4 + max(across * (width + 4), 4 * len(file)))
        png.write(image, 2, 4, file)
        for i, (start, s) in enumerate(zip(pdf["start_frame"], shapes)):
            top, left = LINE + 4 + (i // across) * (height + LINE + 4), 4 + (i % across) * (width + 4)
            png.write(image, top, left, f"{start * secs_per_frame:.2f}S")
            image[top + LINE - 1 : top + LINE - 1 + len(s), left : left + width] = png.scaled(s, scale)
        stem = file.rpartition(".")[0] or file
        return pd.DataFrame({"name": [f"{stem}.png" if nth == 0 else f"{stem}-{nth}.png"], "content": [png.encode(image)]})

    return paged.groupBy("file", "__page").applyInPandas(drawn, "name string, content binary")


def of_outliers(found: DataFrame, frames: DataFrame, size: int, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """file, start_frame and tile of the outliers' windows; only those windows' frames are pooled."""
    from wavesift.operators.outliers import windows_of

    near = windows_of(found, frames, size).where(whole("bins"))

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        got = tile(np.stack(pdf["bins"].to_numpy()), size, 1, rows, columns)[0].ravel() if len(pdf) == size else None
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "start_frame": pdf["start_frame"].iloc[:1], "tile": [got]})

    kind = frames.schema["file"].dataType.simpleString()
    made = near.groupBy("file", "start_frame").applyInPandas(pooled, f"file {kind}, start_frame long, tile array<double>")
    return made.where("tile is not null")
