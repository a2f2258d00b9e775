"""Statistics of waveforms and clips around detections.

Samples with a null place or amplitude count for nothing; a file without others gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.functions.order import with_previous

#: Samples of a file that are put in order together.
CELL = 1 << 16


def stats(samples: DataFrame, sample_rate: int, skipped_secs: float = 0.0) -> DataFrame:
    """Duration, peak, mean magnitude, root mean square and sign changes a second of each file.

    Sign changes are counted between neighbours: n samples have n - 1 chances, one has none.
    """
    x = F.col("amplitude")
    given = samples.where(F.col("n").isNotNull() & x.isNotNull() & (F.col("n") >= int(skipped_secs * sample_rate)))
    beside = with_previous(given, "file", "n", "amplitude", "__before", CELL)
    flips = ((x < 0) != (F.col("__before") < 0)).cast("int")
    got = beside.withColumn("__flip", flips).groupBy("file")
    out = got.agg((F.count("*") / F.lit(sample_rate)).alias("duration"), F.max(F.abs(x)).alias("peak_abs"), F.avg(F.abs(x)).alias("mean_abs"), F.sqrt(F.avg(x * x)).alias("rms"), F.coalesce(F.sum("__flip"), F.lit(0)).alias("__flips"), F.count("*").alias("__n"))
    changes = F.when(F.col("__n") > 1, F.col("__flips") / (F.col("__n") - 1) * sample_rate).otherwise(F.lit(0.0))
    return out.withColumn("zcr", changes).drop("__flips", "__n")


def clips(samples: DataFrame, wanted: DataFrame, sample_rate: int, window_secs: float, skipped_secs: float = 5.0) -> DataFrame:
    """Samples of each wanted (file, start_sec), times counted behind the skipped head.

    Clips that reach past the end are cut; their length is bounded by the window.
    """
    first = ((F.col("start_sec") + F.lit(float(skipped_secs))) * sample_rate).cast("long")
    last = ((F.col("start_sec") + F.lit(float(skipped_secs)) + F.lit(float(window_secs))) * sample_rate).cast("long")
    spans = wanted.select("file", "start_sec", first.alias("__first"), last.alias("__last"))
    # cells as wide as a clip, so that samples meet only clips near them
    width = max(1, int(window_secs * sample_rate))
    spans = spans.withColumn("__cell", F.explode(F.sequence(F.expr(f"__first div {width}"), F.expr(f"__last div {width}"))))
    near = samples.withColumn("__cell", F.expr(f"n div {width}")).join(spans, ["file", "__cell"]).where("n >= __first and n < __last")
    row = F.sort_array(F.collect_list(F.struct("n", "amplitude")))
    got = near.groupBy("file", "start_sec").agg(row.alias("row"))
    return got.select("file", "start_sec", F.element_at("row", 1)["n"].alias("first"), F.transform("row", lambda r: r["amplitude"]).alias("samples"))


def without_audio(outliers: DataFrame, recordings: DataFrame) -> DataFrame:
    """Outliers whose file has no recording."""
    return outliers.join(recordings.select("file").distinct(), "file", "left_anti")
