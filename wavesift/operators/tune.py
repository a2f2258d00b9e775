"""Parameter grids, all their trials in one plan, and the best one.

A trial without F1 comes after all others; of equal ones the first counts. An empty grid
of a parameter gives no trial.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions.order import percentiles
from wavesift.functions.rows import whole, with_matrix
from wavesift.operators.outliers import METRICS

#: Least variance of a component, by the largest one, that a distance is measured along.
SINGULAR = 1e-12


def combinations(parameters: Mapping[str, Sequence]) -> list[dict]:
    """run_num and the parameters of all combinations, the last one fastest."""
    return [{"run_num": i} | dict(zip(parameters, values)) for i, values in enumerate(itertools.product(*parameters.values()), 1)]


def grid(spark: SparkSession, parameters: Mapping[str, Sequence]) -> DataFrame:
    """The same as a table."""
    return spark.createDataFrame([tuple(t.values()) for t in combinations(parameters)], ["run_num", *parameters])


def distances(scores: DataFrame, wanted: Sequence[tuple[str, int]]) -> DataFrame:
    """Add distances: from the centre, for each wanted (metric, number of leading components).

    Scores on components are uncorrelated, so a squared distance is a sum over components, and running
    sums give it for every number at once. A number beyond the components there are means all of them.
    """
    for metric, _ in wanted:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")
    given = scores.where(whole("scores"))
    mean = variance = np.empty(0)
    if not given.isEmpty():
        row = given.select(Summarizer.metrics("mean", "variance").summary(array_to_vector("scores")).alias("s")).first()["s"]
        mean, variance = row["mean"].toArray(), row["variance"].toArray()
    if any(m == "mahalanobis" and (variance[:k] <= SINGULAR * variance.max(initial=0)).any() for m, k in wanted):
        raise ValueError("a direction has no variance: use fewer components")

    def measured(x: np.ndarray) -> np.ndarray:
        squares = (x - mean) ** 2
        run = {"euclidean": np.cumsum(squares, 1), "mahalanobis": np.cumsum(squares / np.where(variance > 0, variance, 1), 1)}
        return np.sqrt(np.stack([run[m][:, min(k, len(mean)) - 1] for m, k in wanted], 1))

    return with_matrix(scores, "scores", "distances", measured, vector=True, width=len(mean))


def outliers(sources: Mapping[str, DataFrame], trials: Sequence[dict]) -> DataFrame:
    """run_num and distance beside the rows of each trial's source that lie strictly beyond its percentile.

    A trial names its source, n_components, metric and percentile; a source has scores. Thresholds of all trials come from
    one set of counts, and a row is compared with those of its source.
    """
    every, place = None, {}
    for name, scores in sources.items():
        wanted = sorted({(t["metric"], t["n_components"]) for t in trials if t["source"] == name})
        place |= {(name, *w): i for i, w in enumerate(wanted)}
        one = distances(scores, wanted).withColumn("source", F.lit(name))
        every = one if every is None else every.unionByName(one)
    long = every.select("source", F.posexplode("distances").alias("place", "distance"))
    percents = sorted({float(t["percentile"]) for t in trials})
    cuts = percentiles(long, "distance", percents, F.concat_ws("\n", "source", F.col("place").cast("string")))
    rules = []
    for t in trials:
        at = place[t["source"], t["metric"], t["n_components"]]
        cut = cuts.get(f"{t['source']}\n{at}")
        if cut is not None:
            rules.append(F.struct(F.lit(t["run_num"]).cast("long").alias("run_num"), F.lit(t["source"]).alias("source"), F.lit(at).alias("place"), F.lit(cut[percents.index(float(t["percentile"]))]).alias("cut")))
    if not rules:
        return every.withColumn("run_num", F.lit(None).cast("long")).withColumn("distance", F.lit(None).cast("double")).drop("distances", "source").limit(0)
    # the grid is given by hand, so its rules are literals
    beyond = lambda r: (r["source"] == F.col("source")) & (F.get("distances", r["place"]) > r["cut"]) & ~F.isnan(F.get("distances", r["place"]))
    hit = every.withColumn("__rule", F.explode(F.filter(F.array(*rules), beyond)))
    return hit.withColumn("run_num", F.col("__rule.run_num")).withColumn("distance", F.get("distances", F.col("__rule.place"))).drop("__rule", "distances", "source")


def of_each(rows: DataFrame, run_nums: Sequence[int]) -> DataFrame:
    """The rows once for each trial."""
    return rows.withColumn("run_num", F.explode(F.array(*[F.lit(n).cast("long") for n in run_nums])))


def best(results: DataFrame) -> DataFrame:
    """The trial with the highest F1; of equal ones the first."""
    return results.orderBy(F.desc("f1"), "run_num").limit(1)
