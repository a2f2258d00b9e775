"""Tumbling and sliding windows over frames; only complete ones count.

Frames without a number belong to no window. Frames before the first don't exist, so a
file's windows start at 0 whatever its least number is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """file and start_frame of all complete windows, from the number of frames alone."""
    t = frames.groupBy("file").agg((F.max("frame") + 1).alias("t")).where(F.col("t") >= size)
    return t.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - size, F.lit(stride).cast("long"))).alias("start_frame"))


def assigned(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Every frame with the start of each window that holds it (one where windows don't overlap)."""
    last = F.expr(f"frame div {stride}")
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"(frame - {size} + {stride}) div {stride}"))
    spread = frames.withColumn("start_frame", F.explode(F.when(first <= last, F.transform(F.sequence(first, last), lambda j: j * stride)).otherwise(F.array().cast("array<bigint>"))))
    return spread.where(f"frame < start_frame + {size}")


def seconds(start_frame, secs_per_frame: float):
    """Start of a window in seconds, rounded half to even at three digits."""
    return F.bround(start_frame * F.lit(secs_per_frame), 3)


def at(frames: DataFrame, file: str, start_secs: float, size: int, secs_per_frame: float) -> DataFrame:
    """The frames of one window of one file; the filter reaches the scan. Empty past the end."""
    first = round(start_secs / secs_per_frame)
    got = frames.where((F.col("file") == file) & F.col("frame").between(first, first + size - 1))
    whole = got.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == size)
    return got.join(F.broadcast(whole.select("file")), "file", "left_semi")
