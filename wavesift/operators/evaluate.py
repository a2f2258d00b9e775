"""Labels against detections: same file and start less than a tolerance apart.

Labels and detections with a null file or start match nothing, but are counted. Repeated
labels are labels of their own; a detection just the tolerance away doesn't match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near(rows: DataFrame, others: DataFrame, tolerance: Column | float, by: Sequence[str] = ("file",)) -> DataFrame:
    """The rows with __met: whether a row of the others is less than the tolerance away.

    Time is cut into cells of half a tolerance. Of each cell the others leave their least and greatest
    time only, before the exchange, so a hot cell is one row. A row meets whatever is in its own cell, the greatest
    time of the two cells before, or the least of the two after; it has one row to join with.
    """
    t, width = F.col("start_sec"), (tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance)))
    cell = F.floor(t / (width / 2))
    seen = others.where(t.isNotNull()).groupBy(*[F.col(k).alias(f"__{k}") for k in by], cell.alias("__in")).agg(F.min(t).alias("__least"), F.max(t).alias("__most"))
    place = F.explode(F.array(*[F.struct(F.lit(j).alias("j")) for j in range(-2, 3)])).alias("__j")
    met = seen.select("*", place).withColumn("__j", F.col("__j.j")).groupBy(*[f"__{k}" for k in by], (F.col("__in") + F.col("__j")).alias("__at"))
    met = met.agg(F.max(F.when(F.col("__j") > 0, F.col("__most"))).alias("__before"), F.min(F.when(F.col("__j") < 0, F.col("__least"))).alias("__after"), F.max(F.col("__j") == 0).alias("__here"))
    joined = rows.withColumn("__cell", cell).join(met, [*[F.col(k) == F.col(f"__{k}") for k in by], F.col("__cell") == F.col("__at")], "left")
    found = F.col("__here") | (t - F.col("__before") < width) | (F.col("__after") - t < width)
    return joined.withColumn("__met", F.coalesce(found, F.lit(False))).drop("__cell", "__at", "__before", "__after", "__here", *[f"__{k}" for k in by])


def matched(labels: DataFrame, detections: DataFrame, tolerance: float) -> DataFrame:
    return near(labels, detections, tolerance).where("__met").drop("__met")


def missed(labels: DataFrame, detections: DataFrame, tolerance: float) -> DataFrame:
    return near(labels, detections, tolerance).where("not __met").drop("__met")


def matches(labels: DataFrame, detections: DataFrame, tolerance: float, key: str = "label_id") -> DataFrame:
    """key, file, start_sec and the sorted times of all detections near each label.

    The lists are the result, so here pairs do meet: by file and cell of the tolerance's width.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(tolerance)))
    left = labels.withColumn("__cell", cell("start_sec"))
    right = detections.select(F.col("file").alias("__file"), F.col("start_sec").alias("detected_sec"), F.explode(F.array(*[cell("start_sec") + j for j in (-1, 0, 1)])).alias("__at"))
    apart = F.abs(F.col("start_sec") - F.col("detected_sec")) < F.lit(float(tolerance))
    near = left.join(right, (F.col("file") == F.col("__file")) & (F.col("__cell") == F.col("__at")) & apart, "left")
    return near.groupBy(key, "file", "start_sec").agg(F.sort_array(F.collect_list("detected_sec")).alias("detected"))


def rated(counts: DataFrame) -> DataFrame:
    """Rows of n_labels, n_matched, n_detections and n_hits with recall, precision, precision_detections and f1.

    A share with nothing below is 0. The numerator of precision is the number of matched labels, so it can
    exceed 1; ``precision_detections`` counts matched detections.
    """
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    one = counts.withColumns({"recall": share("n_matched", "n_labels"), "precision": share("n_matched", "n_detections"), "precision_detections": share("n_hits", "n_detections")})
    both = F.col("recall") + F.col("precision")
    return one.withColumn("f1", F.when(both > 0, 2 * F.col("recall") * F.col("precision") / both).otherwise(F.lit(0.0))).drop("n_hits")


def score(labels: DataFrame, detections: DataFrame, tolerance: Column | float, trials: DataFrame | None = None) -> DataFrame:
    """Counts and shares, in one row; with ``trials`` (run_num and whatever else) a row for each of them.

    Labels and detections then hold run_num too, and each trial's are compared with each other.
    """
    by = ["file"] if trials is None else ["run_num", "file"]
    sides = [near(a, b, tolerance, by).select(*by[:-1], "__met", F.lit(side).alias("__side")) for side, a, b in (("l", labels, detections), ("d", detections, labels))]
    of = lambda side, met=None: F.count_if((F.col("__side") == side) & (F.lit(True) if met is None else F.col("__met")))
    counted = sides[0].unionByName(sides[1]).groupBy(*by[:-1]).agg(of("l").alias("n_labels"), of("l", True).alias("n_matched"), of("d").alias("n_detections"), of("d", True).alias("n_hits"))
    if trials is not None:
        counted = trials.join(counted, "run_num", "left").na.fill(0, ["n_labels", "n_matched", "n_detections", "n_hits"])
    return rated(counted)
