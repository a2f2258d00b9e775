"""Signals and spectrogram frames kept in ordinary tables.

Rows with a null series, order key or value keep their place and take no part later on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.functions.order import placed


def samples_of(events: DataFrame) -> DataFrame:
    """file, n (from 0) and amplitude: one series for each event type, in time order."""
    got = placed(events, "event_type", ["ts", "event_id"], F.to_date("ts"), "n")
    return got.select(F.col("event_type").alias("file"), "n", F.col("value").alias("amplitude"))


def frames_of(embeddings: DataFrame) -> DataFrame:
    """file, frame (from 0) and bins: one spectrogram for each label, in id order."""
    got = placed(embeddings, "label", ["vec_id"], F.expr("vec_id div 4096"), "frame")
    return got.select(F.col("label").alias("file"), "frame", F.transform("embedding", lambda x: x.cast("double")).alias("bins"))


def trimmed(samples: DataFrame, sample_rate: int, start_secs: float, end_secs: float | None) -> DataFrame:
    """Samples between two times; positions keep counting from the start of the series."""
    keep = F.col("n") >= int(start_secs * sample_rate)
    if end_secs is not None:
        keep &= F.col("n") < int(end_secs * sample_rate)
    return samples.where(keep)


def band(frames: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Bins ``start`` up to ``end`` of every frame; an end beyond the last bin means all."""
    if start < 0 or (end is not None and end < start):
        raise ValueError("a band starts at 0 or later and ends where it starts or later")
    size = F.size("bins") if end is None else F.least(F.lit(end), F.size("bins"))
    return frames.withColumn("bins", F.slice("bins", start + 1, F.greatest(size - start, F.lit(0))))


def name_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """name (behind the last slash) and stem (without the last suffix) of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_extract(F.col("name"), r"^(.+?)(\.[^.]*)?$", 1)
    return df.withColumn("name", name).withColumn("stem", stem)
