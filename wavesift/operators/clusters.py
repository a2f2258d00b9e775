"""Groups of outliers by k-means on their leading components.

Rows with null scores take no part. Of fewer rows than clusters each gets one of its
own in the order of file and start; a table without rows has no clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavesift.functions.rows import matrix, whole, with_matrix
from wavesift.operators import evaluate

#: Rounds of drawing candidates, draws of centres among them, rounds of means at most, and gain that ends them.
SEEDING, DRAWS, ROUNDS, SETTLED = 4, 8, 40, 1e-6


def kmeans(rows: DataFrame, k: int = 3, dimensions: int = 10, seed: int = 42) -> tuple[DataFrame, list, float]:
    """Rows with cluster, the centres, and the sum of squared distances."""
    given = rows.where(whole("scores"))
    if len(few := given.select("scores").limit(k).collect()) < k:
        # fewer than k rows, so one task is enough
        place = F.row_number().over(Window.orderBy("file", "start_frame")) - 1
        return given.withColumn("cluster", place), [list(r["scores"][:dimensions]) for r in few], 0.0
    v = given.withColumn("__v", array_to_vector(F.slice("scores", 1, dimensions)))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("__v"), [c.tolist() for c in model.clusterCenters()], model.summary.trainingCost


def _tallied(rows: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Number, sum and cost of the rows nearest to each centre, for every number of clusters, in one pass."""

    def run(batches):
        held = {k: (np.zeros(k), np.zeros(k), np.zeros_like(c)) for k, c in centres.items()}
        for batch in batches:
            x = matrix(batch.column("x"))
            for k, c in centres.items():
                own, far = _nearest(x, c)
                n, cost, total = held[k]
                np.add.at(n, own, 1)
                np.add.at(cost, own, far)
                np.add.at(total, own, x)
        for k, (n, cost, total) in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(cost[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["k", "cluster", "n", "cost", "total"])

    sums = rows.mapInArrow(run, "k int, cluster int, n double, cost double, total array<double>")
    got = sums.groupBy("k", "cluster").agg(F.sum("n"), F.sum("cost"), Summarizer.metrics("sum").summary(array_to_vector("total"))).collect()
    out = ({}, {}, {})
    for k, c in centres.items():
        out[0][k], out[1][k], out[2][k] = np.zeros(k), np.zeros(k), np.zeros_like(c)
    for k, own, n, cost, total in got:
        out[0][k][own], out[1][k][own], out[2][k][own] = n, cost, total["sum"].toArray()
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)
    own = far.argmin(1)
    return own, ((x - centres[own]) ** 2).sum(1)


def _candidates(rows: DataFrame, n: int, per_round: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Some rows that cover all of them, and how many rows are nearest to each.

    Rounds draw rows by their cost to those drawn before, about ``per_round`` each, so far groups get theirs.
    """
    drawn = np.array(rows.orderBy(F.xxhash64("x", F.lit(seed)), "x").select("x").limit(1).first()["x"])[None]
    for turn in range(SEEDING):
        cost = _tallied(rows, {len(drawn): drawn})[1][len(drawn)].sum()
        if not cost > 0:
            break
        known = drawn

        def run(batches):
            for batch in batches:
                x = matrix(batch.column("x"))
                chance = np.array([(h % 2**53) / 2**53 for h in batch.column("h").to_pylist()])
                hit = chance < per_round * _nearest(x, known)[1] / cost
                yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(hit))], names=["x"])

        # the draw hangs on the row and the round alone, so a task that runs again draws the same
        more = rows.withColumn("h", F.abs(F.xxhash64("x", F.lit(seed), F.lit(turn)) % (1 << 53))).mapInArrow(run, "x array<double>").distinct().collect()
        drawn = np.unique(np.concatenate([drawn, np.array([r["x"] for r in more]).reshape(len(more), -1)]), axis=0)
    return drawn, _tallied(rows, {len(drawn): drawn})[0][len(drawn)]


def _seeded(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres among weighted candidates: drawn by cost, the best of some draws after a few rounds of means."""
    best, least = None, np.inf
    for turn in range(DRAWS):
        random = np.random.default_rng((seed, k, turn))
        centres = candidates[[random.choice(len(candidates), p=weight / weight.sum())]]
        while len(centres) < k:
            cost = _nearest(candidates, centres)[1] * weight
            p = cost / cost.sum() if cost.sum() > 0 else weight / weight.sum()
            centres = np.concatenate([centres, candidates[[random.choice(len(candidates), p=p)]]])
        for _ in range(20):
            own = _nearest(candidates, centres)[0]
            mass = np.bincount(own, weight, k)
            sums = np.stack([np.bincount(own, weight * c, k) for c in candidates.T], 1)
            centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        cost = (_nearest(candidates, centres)[1] * weight).sum()
        if cost < least:
            best, least = centres, cost
    return best


def fits(rows: DataFrame, ks: Sequence[int] = range(3, 16), dimensions: int = 10, seed: int = 42) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Centres and sum of squared distances for each number of clusters.

    One seeding serves all numbers; then each pass moves the centres of all of them. There are never more
    clusters than different rows.
    """
    given = rows.where(whole("scores")).select(F.slice("scores", 1, dimensions).cast("array<double>").alias("x")).persist()
    try:
        if given.isEmpty():
            return {}, {}
        n = given.count()
        candidates, weight = _candidates(given, n, 2 * max(ks), seed)
        centres = {k: _seeded(candidates, weight, min(k, len(candidates)), seed) for k in ks}
        centres = {k: c for k, c in centres.items() if len(c) == k} | {len(c): c for k, c in centres.items() if len(c) < k}
        cost: dict[int, float] = {}
        for _ in range(ROUNDS):
            n_of, cost_of, total = _tallied(given, centres)
            now = {k: float(c.sum()) for k, c in cost_of.items()}
            moved = {k: np.where(n_of[k][:, None] > 0, total[k] / np.maximum(n_of[k], 1)[:, None], c) for k, c in centres.items()}
            done = all(k in cost and now[k] >= cost[k] * (1 - SETTLED) for k in centres)
            cost = now
            if done:
                break
            centres = moved
        else:
            cost = {k: float(c.sum()) for k, c in _tallied(given, centres)[1].items()}
        return centres, cost
    finally:
        given.unpersist()


def assigned(rows: DataFrame, centres: dict[int, np.ndarray], dimensions: int = 10) -> DataFrame:
    """Each row once for every number of clusters: k and cluster; rows with null scores take no part."""
    ks = sorted(centres)

    def nearest(x: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(x, centres[k])[0] for k in ks], 1)

    width = len(next(iter(centres.values()))[0]) if centres else 0
    near = with_matrix(rows.where(whole("scores")).withColumn("__x", F.slice("scores", 1, dimensions)), "__x", "__own", nearest, vector=True, width=width).drop("__x")
    each = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in ks]).alias("k"), F.col("__own").alias("own")))
    return near.withColumn("__one", each).withColumns({"k": F.col("__one.k"), "cluster": F.col("__one.own").cast("int")}).drop("__one", "__own")


def sweep(rows: DataFrame, ks: Sequence[int] = range(3, 16), dimensions: int = 10, seed: int = 42, labels: DataFrame | None = None, tolerance: float = 5.0) -> DataFrame:
    """k, cluster, n and inertia (of the whole fit) with several k; with labels (file, start_sec) also n_validated.

    ``n_validated`` counts the rows of a cluster with a label of their file less than the
    tolerance away; ``rows`` need start_sec then.
    """
    marked = rows.withColumn("__met", F.lit(None)) if labels is None else evaluate.near(rows, labels, tolerance)
    centres, cost = fits(rows, ks, dimensions, seed)
    counts = [F.count("*").alias("n")] + ([] if labels is None else [F.count_if("__met").alias("n_validated")])
    if not centres:
        return rows.sparkSession.createDataFrame([], "k int, cluster int, n long, inertia double" + ("" if labels is None else ", n_validated long"))
    inertia = F.create_map(*[F.lit(x) for k, c in cost.items() for x in (k, c)])
    return assigned(marked, centres, dimensions).groupBy("k", "cluster").agg(*counts).withColumn("inertia", inertia[F.col("k")])
