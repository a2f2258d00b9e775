"""Exact k-means of integer vectors, filtered by ball trees.

Each task turns its vectors into blocks of at most ``BLOCK`` and builds a metric tree over
each: a node holds the radius of a ball around its mean, its count and its integer sum,
and its vectors lie next to each other. The trees are written once and serve every round.
In a round the triangle inequality drops, node by node, the centroids that can't be nearest to
anything in the ball: z goes if d(mean, z) - radius > d(mean, nearest) + radius. A ball with
one centroid left goes to it as a whole, by its sum and count; others hand what is left to
their children, and leaves compare their vectors exactly, in integers. A task adds up what
its balls and leaves give, so a round exchanges one row of sums for each task and cluster.

The driver holds the centroids and their sums: k times the dimensions, nothing that grows.

A null vector, one of another size or with a null or non-finite component takes no part. Vectors of null
ids, and rows that share an id, are assigned like any others; a null id is drawn last. Equal hashes
are drawn by the vector. With fewer vectors than k each is a centroid; without any
the result is empty. Of equally near centroids the smaller number wins. A component beyond
``LIMIT`` after scaling is an error, since distances would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.shared import dropped, written
from wavesift.llm.workers import mapped

CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
DIMENSIONS = 64
BLOCK = 4096
LEAF = 32
LIMIT = 1 << 27


class Tree(NamedTuple):
    """Vectors in the order of the leaves; nodes of one level after the other."""

    points: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    radii: np.ndarray


def _levels(n: int, leaf: int) -> list[np.ndarray]:
    """Bounds of the nodes of every level: halves of halves until none exceeds a leaf."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        b = levels[-1]
        levels.append(np.sort(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return levels


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of some integer vectors and the order it puts them into."""
    order = np.arange(len(points))
    levels = _levels(len(points), leaf)
    x = points.astype(np.float64)
    for bounds, below in zip(levels, levels[1:]):
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            part = x[lo:hi]
            first = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
            second = part[((part - first) ** 2).sum(1).argmax()]
            turn = np.argpartition(part @ (second - first), below[2 * i + 1] - lo) if hi - lo > 1 else np.arange(hi - lo)
            x[lo:hi], order[lo:hi] = part[turn], order[lo:hi][turn]
    points = points[order].astype(np.int64)
    sums, counts, radii = [], [], []
    for bounds in levels:
        size = np.diff(bounds)
        # a node of nothing adds nothing
        total = np.add.reduceat(np.concatenate([points, np.zeros((1, points.shape[1]), np.int64)]), bounds[:-1], axis=0)
        total[size == 0] = 0
        mean = total / np.maximum(size, 1)[:, None]
        far = np.sqrt(((points - np.repeat(mean, size, 0)) ** 2).sum(1))
        radius = np.maximum.reduceat(np.append(far, 0.0), bounds[:-1])
        radius[size == 0] = 0
        sums.append(total)
        counts.append(size)
        radii.append(radius)
    return Tree(points, np.concatenate(sums), np.concatenate(counts), np.concatenate(radii)), order


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; by a product of doubles where all sums stay below 2**53."""
    top = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if int(top) ** 2 * 4 * points.shape[1] < 1 << 53:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def descend(tree: Tree, centroids: np.ndarray, leaf: int = LEAF) -> Iterator[tuple[int, int, int | None, np.ndarray | None, np.ndarray]]:
    """Runs of vectors and their cluster: (lo, hi, cluster, None, sum) of whole balls, (lo, hi, None, clusters, -) of leaves."""
    levels = _levels(len(tree.points), leaf)
    c = centroids.astype(np.float64)
    nodes, alive, base = np.array([0]), np.ones((1, len(c)), bool), 0
    for depth, bounds in enumerate(levels):
        at = base + nodes
        mean = tree.sums[at] / np.maximum(tree.counts[at], 1)[:, None]
        d = np.sqrt(((mean[:, None] - c) ** 2).sum(2))
        reach = np.where(alive, d, np.inf).min(1) + 2 * tree.radii[at]
        # the slack covers rounding, so no centroid that ties goes
        alive = alive & (d <= reach[:, None] * (1 + 1e-9) + 1e-9)
        whole = alive.sum(1) == 1
        for node, own in zip(nodes[whole], alive[whole].argmax(1)):
            yield bounds[node], bounds[node + 1], int(own), None, tree.sums[base + node]
        nodes, alive = nodes[~whole], alive[~whole]
        if depth + 1 < len(levels):
            nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(alive, 2, 0)
            base += len(bounds) - 1
    for node, left in zip(nodes, alive):
        lo, hi = bounds[node], bounds[node + 1]
        if hi > lo:
            some = np.flatnonzero(left)
            yield lo, hi, None, some[squares(tree.points[lo:hi], centroids[some]).argmin(1)], None


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    points = column.flatten().to_numpy().reshape(-1, dimensions)
    if len(points) and max(int(points.max()), -int(points.min())) > LIMIT:
        raise ValueError(f"components beyond {LIMIT} in units of the scale")
    return points


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _trees(points: DataFrame, kept: Sequence[T.StructField], dimensions: int, block: int) -> DataFrame:
    """A row for each block: its kept columns as lists, its tree as bytes."""
    parts = ["points", "sums", "counts", "radii"]
    schema = T.StructType([*(T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept), *(T.StructField(p, T.BinaryType()) for p in parts)])

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                rows = pa.Table.from_batches(held).combine_chunks()
                for at in range(0, n - n % block, block):
                    yield rows.slice(at, block)
                held, n = rows.slice(n - n % block).to_batches(), n % block
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        for rows in blocks(batches):
            rows = rows.combine_chunks().to_batches()[0]
            tree, order = build(_matrix(rows.column("__point"), dimensions))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), rows.column(f.name).take(pa.array(order))) for f in kept]
            narrow = tree._replace(points=tree.points.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in narrow)], names=schema.names)

    return mapped(points, run, schema)


def _tree(batch: pa.RecordBatch, row: int, dimensions: int) -> Tree:
    kinds = {"points": np.int32, "sums": np.int64, "counts": np.int64, "radii": np.float64}
    points, sums, counts, radii = (np.frombuffer(batch.column(n)[row].as_buffer(), kind) for n, kind in kinds.items())
    return Tree(points.reshape(-1, dimensions).astype(np.int64), sums.reshape(-1, dimensions), counts, radii)


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of each cluster that isn't empty."""
    k, dimensions = centroids.shape
    names = [f"s{i}" for i in range(dimensions)]

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _tree(batch, row, dimensions)
                for lo, hi, own, each, ball in descend(tree, centroids):
                    if own is not None:
                        count[own] += hi - lo
                        total[own] += ball
                    else:
                        np.add.at(count, each, 1)
                        np.add.at(total, each, tree.points[lo:hi])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(dimensions))], names=["cluster", "n", *names])

    schema = ", ".join(f"{c} long" for c in ["cluster", "n", *names])
    sums = mapped(trees.select("points", "sums", "counts", "radii"), run, schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    return {r[0]: (r[1], list(r[2:])) for r in sums.collect()}


def _assigned(trees: DataFrame, kept: Sequence[T.StructField], centroids: np.ndarray) -> DataFrame:
    """The kept columns of every vector, its cluster and squared distance."""
    dimensions = centroids.shape[1]
    schema = T.StructType([*kept, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _tree(batch, row, dimensions)
                own = np.empty(len(tree.points), np.int32)
                for lo, hi, one, each, _ in descend(tree, centroids):
                    own[lo:hi] = one if each is None else each
                distance = ((tree.points - centroids[own]) ** 2).sum(1)
                lists = [batch.column(f.name).slice(row, 1).flatten() for f in kept]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(own), pa.array(distance)], names=schema.names)

    return mapped(trees, run, schema)


def seeds(points: DataFrame, id_column: str, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    rows = points.select(key.alias("key"), "__point").orderBy(F.asc_nulls_last("key"), "__point").limit(k).collect()
    return np.array([r[1] for r in rows], np.int64)


def clusters(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    column: str = "embedding",
    id_column: str = "vec_id",
    keep: Sequence[str] = ("vec_id",),
    dimensions: int = DIMENSIONS,
    scale: float = SCALE,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """The kept columns of each vector with cluster, distance, cluster_inertia, inertia and centroid (its components).

    Kept columns with the name of an added one are replaced.
    """
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    own = {c: f"__k{i}" for i, c in enumerate(c for c in keep if c.lower() not in added)}
    x = F.col(_quoted(column))
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    points = vectors.where((F.size(x) == dimensions) & ~F.exists(x, bad)).select(
        *[F.col(_quoted(c)).alias(n) for c, n in own.items()],
        F.col(_quoted(id_column)).alias("__id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * float(scale))).alias("__point"),
    )
    kept = [T.StructField(n, points.schema[n].dataType) for n in own.values()]
    # rows are of a megabyte, so small groups of them are read at a time
    trees = written(_trees(points.drop("__id"), kept, dimensions, block), "balls", **{"parquet.block.size": 16 << 20})
    centroids = seeds(points, "__id", k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    for _ in range(rounds):
        for number, (n, total) in _sums(trees, centroids).items():
            centroids[number] = [s // n for s in total]
    found = written(_assigned(trees, kept, centroids), "ball-clusters")
    dropped(trees)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    # k values each, so literals do
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return found.select(
        *[F.col(n).alias(c) for c, n in own.items()],
        "cluster",
        "distance",
        of([inertia.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of([",".join(map(str, c)) for c in centroids.tolist()], "string").alias("centroid"),
    )

