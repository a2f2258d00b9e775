"""Distances from the centre, thresholds and the table of outliers.

Rows with null scores, or scores of another length than the others', get a null distance
and are no outliers. Tables without rows give tables without rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.functions.order import numbered, percentile
from wavesift.functions.rows import moments, with_matrix

METRICS = ("euclidean", "mahalanobis")
#: Least variance of a direction, by the largest one, for a usable covariance.
SINGULAR = 1e-12
#: Frames of a cell of windows that are sorted together when all windows are numbered.
CELL = 1 << 16


def covariance(rows: DataFrame, column: str = "scores") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance."""
    n, mean, products = moments(rows, column)
    return mean, products / max(n - 1, 1)


def centre(rows: DataFrame, metric: str = "mahalanobis", column: str = "scores") -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the matrix that turns differences from it into those whose length is the distance."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")
    mean, cov = covariance(rows, column)
    if metric == "euclidean" or not len(mean):
        return mean, np.eye(len(mean))
    value, vector = np.linalg.eigh(cov)
    if value.min() <= SINGULAR * max(value.max(), 1e-300):
        raise ValueError("a direction has no variance: use fewer components")
    return mean, vector / np.sqrt(value)


def measured(rows: DataFrame, mean: np.ndarray, root: np.ndarray, column: str = "scores") -> DataFrame:
    """Add distance from a centre."""
    return with_matrix(rows, column, "distance", lambda x: np.sqrt((((x - mean) @ root) ** 2).sum(1)), vector=False, width=len(mean))


def distances(rows: DataFrame, metric: str = "mahalanobis", column: str = "scores") -> DataFrame:
    """Add distance from the mean of all rows."""
    return measured(rows, *centre(rows, metric, column), column)


def above(rows: DataFrame, percent: float = 95.0, column: str = "distance") -> DataFrame:
    """Rows strictly beyond the interpolated percentile of all."""
    cut = percentile(rows, column, percent)
    # NaN is above every number in Spark, but no outlier
    return rows.where(F.lit(False) if cut is None else (F.col(column) > cut) & ~F.isnan(F.col(column).cast("double")))


def summary(rows: DataFrame, column: str = "distance") -> DataFrame:
    c = F.col(column)
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def per_file(outliers: DataFrame) -> DataFrame:
    """Outliers of each file, most first."""
    return outliers.groupBy("file").agg(F.count("*").alias("n_outliers")).orderBy(F.desc("n_outliers"), "file")


def table(rows: DataFrame, secs_per_frame: float, percent: float = 95.0) -> DataFrame:
    """index, file, start_frame, start_sec, distance (and scores, if there are) of the outliers, by file and start."""
    start = F.bround(F.col("start_frame") * F.lit(secs_per_frame), 3)
    placed = numbered(rows, "file", "start_frame", F.expr(f"start_frame div {CELL}"))
    found = above(placed, percent).withColumn("start_sec", start)
    more = [c for c in ("scores",) if c in rows.columns]
    return found.select("index", "file", "start_frame", "start_sec", "distance", *more).orderBy("file", "start_sec")


def as_written(found: DataFrame, *more: str) -> DataFrame:
    """The table of outliers with the columns of the CSV, and more; a missing component counts as 0."""
    part = lambda i: F.coalesce(F.get("scores", F.lit(i)), F.lit(0.0))
    return found.select(
        *more,
        F.col("index").alias("Index"), F.col("file").cast("string").alias("File"), F.col("start_frame").alias("Start Frame"), F.col("start_sec").alias("Start Time (s)"),
        F.col("distance").alias("Distance"), part(0).alias("PC1"), part(1).alias("PC2"),
    )


def windows_of(found: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """The frames of each outlier's window: file, start_frame, frame and bins.

    Outliers meet frames by file and cell of ``size`` frames; a window lies in two cells.
    """
    cell = F.expr(f"start_frame div {size}")
    wanted = found.select("file", "start_frame", F.explode(F.array(cell, cell + 1)).alias("__cell"))
    celled = frames.select("file", "frame", "bins", F.expr(f"frame div {size}").alias("__cell"))
    return wanted.join(celled, ["file", "__cell"]).where(f"frame >= start_frame and frame < start_frame + {size}").drop("__cell")
