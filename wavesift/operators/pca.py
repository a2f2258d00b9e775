"""Standardisation and principal components of feature rows.

Rows whose features are null, hold a null or have another length than the others' take
no part in a fit and get null scores. A fit on no rows has no components.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions.rows import matrix, moments, whole, with_matrix

#: Dimensions up to which components come from the covariance matrix; wider rows never make one.
MAX_DIMENSIONS = 2_048
COLUMNS = 4_096
#: Directions sought beyond those wanted, blocks kept before a restart, passes at most, and residual (by the largest value) that ends them.
EXTRA, BLOCKS, PASSES, SETTLED = 10, 4, 100, 1e-9
#: Least variance of a component by that of the first.
RANK = 1e-10


@dataclass(frozen=True)
class Scaler:
    mean: np.ndarray
    std: np.ndarray


@dataclass(frozen=True)
class Components:
    """components (k, D) of scaled features, explained share of variance of each."""

    scaler: Scaler
    components: np.ndarray
    explained: np.ndarray


def _deviation(mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    std = np.sqrt(np.maximum(variance, 0))
    std[std <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    return std


def fit_scaler(features: DataFrame) -> Scaler:
    """Column means and population deviations; a constant column keeps deviation 1."""
    given = features.where(whole("features"))
    if given.isEmpty():
        return Scaler(np.empty(0), np.empty(0))
    row = given.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features")).alias("s")).first()["s"]
    n, mean = row["count"], row["mean"].toArray()
    return Scaler(mean, _deviation(mean, row["variance"].toArray() * (n - 1) / max(n, 1)))


def scaled(features: DataFrame, scaler: Scaler) -> DataFrame:
    """features as z-scores."""
    mean, std = scaler.mean, scaler.std
    return with_matrix(features, "features", "features", lambda x: (x - mean) / std, vector=True, width=len(mean))


def _signed(components: np.ndarray) -> np.ndarray:
    """Each component with its largest loading positive, so that results don't flip."""
    at = np.abs(components).argmax(axis=1)
    sign = np.sign(components[np.arange(len(components)), at])
    return components * np.where(sign == 0, 1, sign)[:, None]


def _leading(value: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that are not zero, and their vectors as columns."""
    order = np.argsort(-value)[:k]
    order = order[value[order] > RANK * max(value.max(initial=0.0), 1e-300)]
    return value[order], vector[:, order]


def fit(features: DataFrame, k: int) -> Components:
    """Components of the z-scores, as many as their rank allows at most."""
    one = features.where(whole("features")).select(F.size("features")).first()
    width = one[0] if one else 0
    if width <= MAX_DIMENSIONS:
        n, mean, products = moments(features, "features")
        std = _deviation(mean, products.diagonal() / max(n, 1))
        scaler = Scaler(mean, std)
        if not n:
            return Components(scaler, np.empty((0, 0)), np.empty(0))
        # the z-scores' covariance, with nothing left of columns that don't vary
        spread = products / n / np.outer(std, std)
        total = spread.trace()
        value, vector = _leading(*np.linalg.eigh(spread), k)
        return Components(scaler, _signed(vector.T), value / total if total > 0 else value)
    scaler = fit_scaler(features)
    return Components(scaler, *_krylov(scaled(features, scaler), width, k))


def _applied(rows: DataFrame, q: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Number of rows, their sum of squares, and rows.T @ rows @ q, in one pass.

    Each task multiplies its rows with the directions and sends the sums back by blocks of columns.
    """
    width = len(q)
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def products(batches):
        n, squares, total = 0, 0.0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = matrix(batch.column("features").slice(at, 256))
                total = x.T @ (x @ shared.value) + (0 if total is None else total)
                n, squares = n + len(x), squares + float((x * x).sum())
        for at in range(0, width if n else 0, COLUMNS):
            part = total[at : at + COLUMNS]
            yield pd.DataFrame({"block": np.array([at // COLUMNS], np.int32), "n": [n], "squares": [squares], "p": [part.ravel()]})

    sums = rows.mapInArrow(lambda batches: map(_record, products(batches)), "block int, n long, squares double, p array<double>")
    got = sums.groupBy("block").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), Summarizer.metrics("sum").summary(array_to_vector("p")).alias("p")).orderBy("block").collect()
    shared.destroy()
    if not got:
        return 0, 0.0, np.zeros_like(q)
    return got[0]["n"], got[0]["squares"], np.concatenate([r["p"]["sum"].toArray().reshape(-1, q.shape[1]) for r in got])


def _new(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of a block that the basis doesn't hold; what is only rounding goes."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def _krylov(z: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of wide rows by a block Krylov space of their inner products, whatever the number of rows.

    A pass multiplies the newest block of directions; the best ones inside all blocks so far are known from
    products that are there already. It ends when they are eigenvectors, or when the rows hold no further
    direction. After ``BLOCKS`` blocks the best of them start anew. Held on the driver: ``2 * BLOCKS``
    times ``width`` times ``k + EXTRA`` numbers; a task holds one block. Rows are never joined or named.
    """
    given = z.where(F.col("features").isNotNull()).select("features")
    size = min(k + EXTRA, width)
    block = np.linalg.qr(np.random.default_rng(7).normal(size=(width, size)))[0]
    basis, products = np.empty((width, 0)), np.empty((width, 0))
    for _ in range(PASSES):
        _, total, image = _applied(given, block)
        basis, products = np.hstack([basis, block]), np.hstack([products, image])
        inner = basis.T @ products
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        value, turn = value[::-1][:size], turn[:, ::-1][:, :size]
        left = products @ turn - basis @ turn * value
        if not total or (np.linalg.norm(left[:, :k], axis=0) <= SETTLED * max(value[0], 1e-300)).all():
            break
        if basis.shape[1] >= BLOCKS * size:
            basis, products = basis @ turn, products @ turn
        block = _new(left, basis)
        if not block.shape[1]:
            break
    components = (basis @ turn)[:, :k].T
    good = value[:k] > RANK * max(value[0], 1e-300)
    return _signed(components[good]), value[:k][good] / (total or 1.0)


def _record(pdf: pd.DataFrame):
    import pyarrow as pa

    return pa.RecordBatch.from_pandas(pdf, preserve_index=False)


def transform(features: DataFrame, model: Components, k: int | None = None) -> DataFrame:
    """Add scores: the first k components of each row. Components are nested, so one fit serves every k."""
    mean, std, c = model.scaler.mean, model.scaler.std, model.components[:k]
    return with_matrix(features, "features", "scores", lambda x: ((x - mean) / std) @ c.T, vector=True, width=len(mean))


_SAVED = "name string, i int, values array<double>, note string"


def save(model: Components, spark: SparkSession, path: str, settings: dict | None = None) -> None:
    """Write a fit, and the settings it was made with, as a small Parquet table."""
    rows = [("mean", 0, model.scaler.mean.tolist(), None), ("std", 0, model.scaler.std.tolist(), None), ("explained", 0, model.explained.tolist(), None)]
    rows += [("component", i, c.tolist(), None) for i, c in enumerate(model.components)]
    rows.append(("settings", 0, None, json.dumps(settings or {})))
    spark.createDataFrame(rows, _SAVED).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Components, dict]:
    """A saved fit and its settings."""
    rows = sorted(spark.read.schema(_SAVED).parquet(path).collect(), key=lambda r: (r["name"], r["i"]))
    one = {r["name"]: r for r in rows}
    components = [r["values"] for r in rows if r["name"] == "component"]
    scaler = Scaler(np.array(one["mean"]["values"]), np.array(one["std"]["values"]))
    width = len(scaler.mean)
    return Components(scaler, np.array(components, float).reshape(len(components), width), np.array(one["explained"]["values"])), json.loads(one["settings"]["note"])
