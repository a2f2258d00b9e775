"""Text reports as tables of lines, which a text sink writes in order; every row is listed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.operators import outliers


def _lines(spark, *parts: list[str] | tuple[DataFrame, Column, Sequence[Column]]) -> DataFrame:
    """Lines of all parts in order; a part is a list of texts, or rows, the line of each, and the three columns they are sorted by."""
    tables = []
    for i, part in enumerate(parts):
        if isinstance(part, list):
            tables.append(spark.createDataFrame([(i, float(k), None, None, x) for k, x in enumerate(part)], "part int, a double, b string, c double, line string"))
        else:
            rows, line, (a, b, c) = part
            tables.append(rows.select(F.lit(i).alias("part"), a.cast("double").alias("a"), b.cast("string").alias("b"), c.cast("double").alias("c"), line.alias("line")))
    return reduce(DataFrame.unionByName, tables).orderBy("part", "a", "b", "c").select("line")


def _number(x: float | None) -> str:
    return "none" if x is None else f"{x:.4f}"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("?"))


def outlier_lines(scored: DataFrame, found: DataFrame, metric: str, percent: float, threshold: float | None) -> DataFrame:
    """The segments found, their number in each file, and the distances and settings they come from."""
    s = outliers.summary(scored).first()
    part = lambda i: F.coalesce(F.get("scores", F.lit(i)), F.lit(0.0))
    segment = F.format_string("%s @ %.3f s: window %d, frame %d, distance %.5f, scores (%.5f, %.5f)", _text("file"), "start_sec", "index", "start_frame", "distance", part(0), part(1))
    files = outliers.per_file(found)
    tail = [
        "", "[distances]", f"measure = {metric}", f"cut = {_number(threshold)}", f"cut_percentile = {percent:g}", f"windows = {s['n']}", f"windows_beyond = {found.count()}",
        f"smallest = {_number(s['min'])}", f"largest = {_number(s['max'])}", f"average = {_number(s['mean'])}", f"spread = {_number(s['std'])}",
    ]
    return _lines(
        found.sparkSession, ["[segments]"], (found, segment, (F.lit(0), F.col("file"), F.col("start_sec"))),
        ["", "[files]"], (files, F.format_string("%d in %s", "n_outliers", _text("file")), (-F.col("n_outliers"), F.col("file"), F.lit(0))), tail,
    )


def score_lines(score: DataFrame, matched: DataFrame, missed: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """Shares and counts, every label that no segment is near, names that several files have, and the labels found."""
    r = score.first()
    head = [
        "[agreement]", f"f1 = {r['f1']:.4f}", f"precision = {r['precision']:.4f}", f"recall = {r['recall']:.4f}", f"labels = {r['n_labels']}", f"found = {r['n_matched']}",
        f"unseen = {r['n_labels'] - r['n_matched']}", f"segments = {r['n_detections']}", "", "[unseen]",
    ]
    listed = lambda df: (df, F.format_string("%s @ %s s", _text("file"), _text("start_sec")), (F.lit(0), F.col("file"), F.col("start_sec")))
    parts = [head, listed(missed)]
    if ambiguous is not None:
        parts += [["", "[ambiguous names]"], (ambiguous, F.format_string("%s: %d files", _text("file"), "n_files"), (F.lit(0), F.col("file"), F.lit(0)))]
    return _lines(score.sparkSession, *parts, ["", "[found]"], listed(matched))
