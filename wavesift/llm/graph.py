"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm.shared import dropped, written
from wavesift.llm.workers import mapped


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or all not larger) neighbours of each node to its least neighbour.

    One exchange by node; in the order of neighbours the first is the least, so a task streams the edges of a
    node of any degree, and equal ones lie next to each other.
    """

    def run(batches):
        node = least = last = None
        for batch in batches:
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            if not len(u):
                continue
            begins = np.append(True, u[1:] != u[:-1])
            new = begins | np.append(True, v[1:] != v[:-1])
            first = np.flatnonzero(begins)
            m = np.minimum(v[first], u[first]) if large else v[first].copy()
            if node == u[0]:
                begins[0], new[0], m[0] = False, v[0] != last, least
            m_of = np.repeat(m, np.diff(np.append(first, len(u))))
            node, least, last = u[-1], m_of[-1], v[-1]
            if large:
                out = new & (v > u) & (v != m_of)
                a, b = v[out], m_of[out]
            else:
                out = new & (v != m_of)
                a, b = np.concatenate([v[out], u[begins]]), np.concatenate([m_of[out], m_of[begins]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    # the small star's edges run from the larger node to the smaller one
    sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    return mapped(sides.repartition("u").sortWithinPartitions("u", "v"), run, "u long, v long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    ``edges`` has long columns u and v. Self-loops and repeated edges change nothing.
    Each round is written to the shared folder; it ends when the stars stay the same.
    Their number grows with the logarithm of the longest path; raises if ``rounds`` don't do.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "components")
    before = None
    for _ in range(rounds):
        last, now = now, written(_star(_star(now, True), False).distinct(), "components")
        dropped(last)
        # the same number of edges and the same sums of two hashes: the stars stay as they are
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.written_at = now.written_at
    return out
