"""Nearest neighbours by balanced posting lists with replicated boundary vectors.

1. Centroids come from a sample by k-means whose assignments pay for the size a list
   already has, so lists end up balanced. There are as many lists as ``ROWS_PER_LIST``
   asks for up to ``MANY``, and beyond, their number and their length grow alike, with the
   root of the vectors. Many centroids are fitted in two levels. The sample has ``MIN_SAMPLE``
   vectors, or ``PER_LIST`` for each list if that is more, and is what the driver holds.
2. A navigable graph over the centroids is held in memory by every task: near neighbours
   kept only if no closer one leads there, links back, and a link between parts that
   would be apart. Best-first search on it finds the lists near a vector.
3. Every vector goes to its nearest list and, if it lies near a boundary, to the other
   lists within ``closure`` times the least distance, ``replicas`` lists at most.
4. A query reads the lists whose centroid is within ``ratio`` times the distance of the
   nearest one; there is no cap on their number. Unless given, the ratio is the one that
   finds the share ``TARGET`` of true neighbours within the sample, where neighbours are
   farther apart than among all vectors. Lists meet their queries in an exchange,
   long lists in blocks and many queries in chunks; each block compares
   original vectors in double precision and hands on the nearest only.
5. Queries that found fewer than ``k`` ids go on to farther lists, ``WIDEN`` times as
   many each round, until they have ``k`` or have read all lists.

Vectors that are null, all zeros, of another length than most, or that hold null or
non-finite components take no part. Rows that share a vec_id are versions of one vector: each is a
candidate, the nearest counts, and none is a candidate of the query of that id; of a
query the version with the least components is asked. Null ids take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.shared import dropped, written
from wavesift.llm.workers import mapped

#: Vectors the centroids are fitted on, those with the least hash of the id: so many, or so many for each list.
MIN_SAMPLE, PER_LIST = 20_000, 4
ROWS_PER_LIST = 128
#: Lists that are fitted, and linked, all at once; beyond, their number grows with the root of the vectors.
MANY = 2_048
#: Cells of the upper level whose centroids may become neighbours in the graph.
NEAR_CELLS = 8
#: Distances that a task holds while it searches.
HELD_DISTANCES = 1 << 22
DEGREE = 16
REPLICAS = 4
CLOSURE = 1.02
TARGET = 0.99
#: Vectors of the sample that set the ratio, and nodes that a search expands at least.
ASKED = 256
WIDTH = 32
BLOCK = 1_024
CHUNK = 2_048
#: Lists of a query's second round, and how many times as many each further one has.
SECOND = 2
WIDEN = 8
#: Queries whose best candidates a task holds at a time.
HELD = 20_000


@dataclass(frozen=True)
class Centroids:
    """points (k, d); links (k, DEGREE or more), padded with the node itself."""

    points: np.ndarray
    links: np.ndarray


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def balanced_centroids(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """k-means in which a list that is already long costs more."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    points = x[rng.choice(len(x), k, replace=False)].copy()
    for step in range(steps):
        size = np.zeros(k)
        label = np.empty(len(x), np.int64)
        order = rng.permutation(len(x))
        spread = None
        for lo in range(0, len(x), 512):
            part = order[lo : lo + 512]
            d = _distances(x[part], points)
            spread = d.min(1).mean() if spread is None else spread
            label[part] = (d + 0.2 * spread * size * k / len(x)).argmin(1)
            size += np.bincount(label[part], minlength=k)
        total = np.zeros_like(points)
        np.add.at(total, label, x)
        full = size > 0
        points[full] = total[full] / size[full, None]
        if not full.all():
            points[~full] = x[rng.choice(len(x), int((~full).sum()), replace=False)]
    return np.unique(points, axis=0)


def lists_for(n: int) -> int:
    """Lists for so many vectors."""
    return max(1, int(min(n // ROWS_PER_LIST, max(MANY, (n * MANY / ROWS_PER_LIST) ** 0.5))))


def _nearest_of(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[lo : lo + 512], points).argmin(1) for lo in range(0, len(x), 512)])


def centroids(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k balanced centroids, and the cell of the upper level of each (all in one up to MANY)."""
    if k <= MANY:
        points = balanced_centroids(x, k)
        return points, np.zeros(len(points), np.int64)
    upper = balanced_centroids(x[:MIN_SAMPLE], int(k**0.5) + 1)
    cell = _nearest_of(x, upper)
    points = [balanced_centroids(x[cell == c], -(-k * int((cell == c).sum()) // len(x))) for c in range(len(upper)) if (cell == c).any()]
    points = np.unique(np.concatenate(points), axis=0)
    return points, _nearest_of(points, upper)


def _candidates(points: np.ndarray, cell: np.ndarray, most: int):
    """Each centroid with the nearest others, of its own cell and the cells near it."""
    cells = np.unique(cell)
    middle = np.stack([points[cell == c].mean(0) for c in cells])
    for c in range(len(cells)):
        close = np.argsort(_distances(middle[c : c + 1], middle)[0], kind="stable")[:NEAR_CELLS]
        there = np.flatnonzero(np.isin(cell, cells[close]))
        own = np.flatnonzero(cell == cells[c])
        for lo in range(0, len(own), 512):
            rows = own[lo : lo + 512]
            away = _distances(points[rows], points[there])
            for i, d in zip(rows.tolist(), away, strict=True):
                order = there[np.argsort(d, kind="stable")]
                yield i, order[order != i][:most]


def linked(points: np.ndarray, cell: np.ndarray | None = None, degree: int = DEGREE) -> Centroids:
    """The graph over the centroids."""
    k = len(points)
    links: list[list[int]] = [[] for _ in range(k)]
    for i, order in _candidates(points, np.zeros(k, np.int64) if cell is None else cell, 4 * degree) if k else ():
        group = np.concatenate([[i], order])
        between = np.sqrt(_distances(points[group], points[group]))
        taken: list[int] = []
        for j in range(1, len(group)):
            if len(taken) >= degree:
                break
            if not taken or between[j, taken].min() > between[0, j]:
                taken.append(j)
        taken += [j for j in range(1, len(group)) if j not in taken][: degree - len(taken)]
        links[i] = group[taken].tolist()
    both = [set(x) for x in links]
    for i, near in enumerate(links):
        for j in near:
            if len(both[j]) < 2 * degree:
                both[j].add(i)
    # what cannot be reached from node 0 gets a link from the nearest node that can
    seen = np.zeros(k, bool)
    todo = [0] if k else []
    while todo or not seen.all():
        if not todo:
            far = int(np.flatnonzero(~seen)[0])
            near = np.flatnonzero(seen)
            close = int(near[_distances(points[far : far + 1], points[near])[0].argmin()])
            both[close].add(far)
            both[far].add(close)
            todo = [far]
        i = todo.pop()
        if not seen[i]:
            seen[i] = True
            todo += [j for j in both[i] if not seen[j]]
    width = max(map(len, both), default=0)
    table = np.repeat(np.arange(k)[:, None], max(width, 1), axis=1)
    for i, near in enumerate(both):
        table[i, : len(near)] = sorted(near)
    return Centroids(points, table)


def _reach(ratio: float, dist: np.ndarray) -> np.ndarray:
    """``ratio`` times the distances; without end for an infinite ratio, also of 0."""
    return np.full_like(dist, np.inf) if np.isinf(ratio) else ratio * dist


def search(index: Centroids, x: np.ndarray, ratio: float, width: int) -> np.ndarray:
    """Distances of x to the centroids that best-first search meets, inf for all others.

    A row goes on until the nearest node not yet expanded is beyond ``ratio`` times the
    best distance and ``width`` nodes were expanded.
    """
    m, k = len(x), len(index.points)
    dist = np.full((m, k), np.inf)
    dist[:, 0] = np.sqrt(((x - index.points[0]) ** 2).sum(1))
    front = dist.copy()
    best = dist[:, 0].copy()
    live = np.arange(m)
    for step in range(k):
        j = front[live].argmin(1)
        d = front[live, j]
        go = np.isfinite(d) & ((d <= _reach(ratio, best[live])) | (step < width))
        live, j = live[go], j[go]
        if not len(live):
            break
        front[live, j] = np.inf
        near = index.links[j]
        row, col = np.nonzero(np.isinf(dist[live[:, None], near]))
        row, node = live[row], near[row, col]
        new = np.sqrt(((x[row] - index.points[node]) ** 2).sum(1))
        dist[row, node] = front[row, node] = new
        np.minimum.at(best, row, new)
    return dist


def calibrated(index: Centroids, x: np.ndarray, closure: float, replicas: int, k: int = 10) -> float:
    """The ratio at which ASKED vectors of x find the share TARGET of their k nearest in x."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return np.inf
    if len(x) > MIN_SAMPLE:
        x = x[:: -(-len(x) // MIN_SAMPLE)]
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(np.int64)
    row, at = [], []
    for lo in range(0, len(x), 256):
        r, a = _closure(index, x[lo : lo + 256], closure, replicas)
        row.append(r + lo)
        at.append(a)
    row, at = np.concatenate(row), np.concatenate(at)
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    lists = np.full((len(x), replicas), -1)
    lists[row, np.arange(len(row)) - np.searchsorted(row, row)] = at
    away = _distances(x[asked], x)
    away[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(away, k, axis=1)[:, :k]
    dist = np.sqrt(_distances(x[asked], index.points))
    held = lists[near]
    needed = np.where(held >= 0, dist[np.arange(len(asked))[:, None, None], held], np.inf).min(2)
    return float(np.quantile(needed / np.maximum(dist.min(1, keepdims=True), 1e-300), TARGET))


def _closure(index: Centroids, x: np.ndarray, closure: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the nearest list of each vector and of others nearly as near."""
    dist = search(index, x, 1.0, WIDTH)
    most = min(replicas, dist.shape[1])
    order = np.argpartition(dist, most - 1, axis=1)[:, :most]
    near = np.take_along_axis(dist, order, 1)
    row, col = np.nonzero(near <= closure * near.min(1, keepdims=True))
    return row, order[row, col]


def valid(df: DataFrame, vector: str, length: int) -> DataFrame:
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) == length) & fine & F.exists(v, lambda x: x != 0))


def _flat(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", closure: float = CLOSURE, replicas: int = REPLICAS) -> tuple[Centroids, int, float]:
    """Centroids and their graph from a sample, the vectors' length, and the ratio."""
    v = F.col(f"`{vector}`")
    sizes = vectors.where(v.isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return Centroids(np.empty((0, 0)), np.empty((0, 1), np.int64)), 0, 1.0
    length, n = sizes["size"], sizes["count"]
    sample = valid(vectors.select(F.col(f"`{key}`").alias("key"), v.alias("vector")), "vector", length)
    lists = lists_for(n)
    got = sample.orderBy(F.xxhash64("key", "vector"), "key").limit(max(MIN_SAMPLE, PER_LIST * lists)).select("vector").toArrow()
    if not got.num_rows:
        return Centroids(np.empty((0, length)), np.empty((0, 1), np.int64)), length, 1.0
    x = _flat(got.column("vector").combine_chunks(), length)
    index = linked(*centroids(x, lists))
    return index, length, calibrated(index, x, closure, replicas)


def _posted(rows: DataFrame, index, length: int, kind: str, lists_of) -> DataFrame:
    """(list, salt, id, v) of each row and each of its lists."""

    def run(batches):
        salt = 0
        for batch in batches:
            at_once = max(8, min(256, HELD_DISTANCES // len(index.value.points)))
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                x = _flat(part.column("vector"), length)
                row, at = lists_of(index.value, x)
                raw = np.ascontiguousarray(x.astype(kind))
                binary = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * raw[:1].nbytes).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array((salt + row).astype(np.int64)), part.column("key").take(pa.array(row)), binary.take(pa.array(row))],
                    names=["list", "salt", "id", "v"],
                )
                salt += len(x)

    return mapped(rows, run, "list int, salt long, id long, v binary")


def _nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int):
    """(position of the query, id, distance) of the k nearest ids of each query, and what ties with them."""
    rough = _distances(q, x)
    rough[q_id[:, None] == x_id[None, :]] = np.inf
    ids, first = np.unique(x_id[by_id := np.argsort(x_id, kind="stable")], return_index=True)
    # the least distance of each id, so that versions of one vector take one of the k places
    least = rough if len(ids) == len(x_id) else np.minimum.reduceat(rough[:, by_id], first, axis=1)
    most = min(k, len(ids))
    kth = np.partition(least, most - 1, axis=1)[:, most - 1]
    # the product form is off by rounding; whatever may belong to the nearest is measured exactly
    slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
    row, col = np.nonzero((rough <= (kth + slack)[:, None]) & np.isfinite(rough))
    return row, x_id[col], np.sqrt(((q[row] - x[col]) ** 2).sum(1))


def _best(query: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest distinct ids of every query."""
    order = np.lexsort((score, near, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order][1:] != query[order][:-1]) | (near[order][1:] != near[order][:-1])
    order = order[new]
    order = order[np.lexsort((near[order], score[order], query[order]))]
    head = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - head < k]


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", ratio: float | None = None, closure: float = CLOSURE, replicas: int = REPLICAS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query."""
    spark = vectors.sparkSession
    index, length, fitted = fit(vectors, key, vector, closure, replicas)
    ratio = fitted if ratio is None else ratio
    if not len(index.points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    kind = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "<f8"

    def plain(df):
        return valid(df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").alias("vector")), "vector", length).where("key is not null")

    def probes(index, x):
        dist = search(index, x, ratio, WIDTH)
        return np.nonzero(np.isfinite(dist) & (dist <= _reach(ratio, dist.min(1, keepdims=True))))

    def farther(lists: int):
        """Lists within the ratio of the ``lists``-th nearest."""

        def run(index, x):
            dist = np.sqrt(_distances(x, index.points))
            if lists >= dist.shape[1]:
                return np.nonzero(np.isfinite(dist))
            return np.nonzero(dist <= _reach(max(ratio, 1.0), np.partition(dist, lists - 1, axis=1)[:, lists - 1 : lists]))

        return run

    posted = written(_posted(plain(vectors), shared, length, kind, lambda i, x: _closure(i, x, closure, replicas)), "ann-lists")
    once = plain(queries).groupBy("key").agg(F.min("vector").alias("vector"))

    def compare(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0
        for x, x_id, q, q_id in _groups(batches, kind):
            row, near, score = _nearest(q, q_id, x, x_id, k)
            held.append((q_id[row], near, score))
            n_held += len(row)
            if n_held > HELD * k:
                held = [_shrunk(held, k)]
                n_held = len(held[0][0])
                if n_held > HELD * k // 2:
                    yield _batch(held[0])
                    held, n_held = [], 0
        if held:
            yield _batch(_shrunk(held, k))

    def met(asked):
        """What the queries find in their lists."""
        # one row a list; the lists' centroids are with every task anyway
        blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        sizes = F.broadcast(blocks.join(chunks, "list"))
        lists = posted.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id", "salt"), F.col("blocks")).cast("int"))
        lists = lists.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        wanted = asked.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        names = ["list", "block", "chunk", "id", "v"]
        both = lists.select(*names, F.lit(0).alias("side")).unionByName(wanted.select(*names, F.lit(1).alias("side")))
        dealt = both.repartition("list", "block", "chunk").sortWithinPartitions("list", "block", "chunk", "side")
        return written(mapped(dealt, compare, "query_id long, vec_id long, score double"), "ann-found")

    asked = written(_posted(once, shared, length, kind, probes), "ann-queries")
    found = met(asked)
    dropped(asked)
    short, lists = once, SECOND
    while True:
        enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
        short = written(short.join(enough, F.col("key") == F.col("query_id"), "left_anti"), "ann-short")
        if short.isEmpty():
            break
        asked = written(_posted(short, shared, length, kind, farther(lists)), "ann-queries")
        found = found.unionByName(met(asked))
        dropped(asked)
        if lists >= len(index.points):
            break
        lists *= WIDEN
    dropped(posted, shared)
    # a vector found in several lists has the same score there, so it keeps one rank
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    least = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return least.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shrunk(held, k: int):
    query, near, score = (np.concatenate(c) for c in zip(*held, strict=True))
    keep = _best(query, near, score, k)
    return query[keep], near[keep], score[keep]


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _groups(batches, kind: str):
    """(vectors, ids, queries, ids) of each list block that has both, from a sorted partition."""
    now, parts = None, ([], [])

    def done():
        if parts[0] and parts[1]:
            sides = []
            for side in parts:
                ids = np.concatenate([i for i, _ in side])
                sides += [np.frombuffer(b"".join(v for _, v in side), kind).astype(np.float64).reshape(len(ids), -1), ids]
            yield sides[0], sides[1], sides[2], sides[3]

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "chunk", "side")], axis=1)
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
        for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
            group = tuple(keys[lo, :3])
            if group != now:
                yield from done()
                now, parts = group, ([], [])
            raw = batch.column("v").slice(lo, hi - lo)
            off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            parts[keys[lo, 3]].append((batch.column("id").slice(lo, hi - lo).to_numpy(), bytes(raw.buffers()[2])[off[0] : off[-1]]))
    yield from done()
