"""Order statistics and places in an order, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a double that one pass tells apart; so 2**16 counts of a group reach the driver at most.
DIGIT = 16


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)


def _double(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & (2**64 - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _counted(values: DataFrame, digit: int, wanted: dict) -> dict:
    """By group and leading digits: number, least and greatest value, of those whose digits before are wanted."""
    shift = np.uint64(64 - DIGIT * (digit + 1))

    def run(batches):
        held: dict = {}
        for batch in batches:
            group = pc.dictionary_encode(batch.column("g"), null_encoding="encode")
            names, code = group.dictionary.to_pylist(), group.indices.to_numpy()
            x = _sortable(batch.column("v").to_numpy())
            for i, name in enumerate(names):
                mine = x[code == i]
                if digit:
                    ahead = np.array(sorted(wanted.get(name, ())), np.uint64)
                    mine = mine[np.isin(mine >> (shift + np.uint64(DIGIT)), ahead)]
                lead, place = np.unique(mine >> shift, return_inverse=True)
                order = np.argsort(place, kind="stable")
                first = np.searchsorted(place[order], np.arange(len(lead)))
                ordered = mine[order]
                for d, n, lo, hi in zip(lead.tolist(), np.bincount(place, minlength=len(lead)).tolist(), *(f.reduceat(ordered, first).tolist() if len(lead) else [] for f in (np.minimum, np.maximum))):
                    m, a, b = held.get((name, d), (0, lo, hi))
                    held[name, d] = (m + n, min(a, lo), max(b, hi))
        rows = [(g, d, n, a.to_bytes(8), b.to_bytes(8)) for (g, d), (n, a, b) in held.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        # the last digits fill all 64 bits, so they travel as signed ones
        columns = list(zip(*rows)) or [[]] * 5
        columns[1] = np.array(columns[1], np.uint64).view(np.int64) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["g", "d", "n", "lo", "hi"])

    got = values.mapInArrow(run, "g string, d long, n long, lo binary, hi binary").groupBy("g", "d").agg(F.sum("n"), F.min("lo"), F.max("hi")).collect()
    return {(g, d % 2**64): (n, int.from_bytes(lo), int.from_bytes(hi)) for g, d, n, lo, hi in got}


def percentiles(rows: DataFrame, column: str, percents: Sequence[float], by: Column | None = None) -> dict[str | None, list[float]]:
    """Exact interpolated percentiles of each group (a text, or None for all rows); nulls and NaN don't count.

    Doubles become integers of the same order. A pass counts them by their next 16 bits, among those that
    share the bits before with a wanted one, for all groups and percentiles at once. It ends when
    all that share a wanted one's bits are equal, after four passes at the latest and mostly after two. Nothing is sorted.
    """
    group = F.lit(None) if by is None else by
    c = F.col(column).cast("double")
    values = rows.select(group.cast("string").alias("g"), c.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = _counted(values, 0, {})
    totals: dict = {}
    for (g, _), (n, *_ends) in counts.items():
        totals[g] = totals.get(g, 0) + n
    # an order statistic: its group, rank, and the values before its digits
    open_ranks = {(g, r): 0 for g, n in totals.items() for p in percents for r in (int((n - 1) * p / 100), min(int((n - 1) * p / 100) + 1, n - 1))}
    found: dict = {}
    prefix: dict = {}
    for digit in range(64 // DIGIT):
        if digit:
            wanted: dict = {}
            for g, r in open_ranks:
                wanted.setdefault(g, set()).add(prefix[g, r])
            counts = _counted(values, digit, wanted)
        leads: dict = {}
        for g, d in sorted(counts, key=lambda k: k[1]):
            leads.setdefault(g, []).append(d)
        for (g, r), before in list(open_ranks.items()):
            for d in leads[g]:
                if digit and d >> DIGIT != prefix[g, r]:
                    continue
                n, lo, hi = counts[g, d]
                if r < before + n:
                    break
                before += n
            prefix[g, r], open_ranks[g, r] = d, before
            if lo == hi:
                found[g, r] = _double(lo)
                del open_ranks[g, r]
        if not open_ranks:
            break
    out: dict = {}
    for g, n in totals.items():
        out[g] = []
        for p in percents:
            at = (n - 1) * p / 100
            low, high = found[g, int(at)], found[g, min(int(at) + 1, n - 1)]
            out[g].append(low if at == int(at) else low + (high - low) * (at - int(at)))
    return out


def percentile(rows: DataFrame, column: str, percent: float) -> float | None:
    """Exact interpolated percentile of all rows; without values it is None."""
    return percentiles(rows, column, [percent]).get(None, [None])[0]


def numbered(rows: DataFrame, group: str, order: str, cell: Column, name: str = "index") -> DataFrame:
    """Add the place of each row among all, by ``group`` and then ``order``, from 0.

    Rows are counted by group and ``cell``, a coarser form of ``order``, so that no group
    is sorted in one task. The cells' totals are summed in sorted partitions; one number
    of each partition comes to the driver.
    """
    celled = rows.withColumn("__cell", cell)
    counts = celled.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    # kept, as the partitions must be the same in both passes
    placed = counts.orderBy(group, "__cell").withColumn("__part", F.spark_partition_id()).persist()
    ahead, total = [], 0
    for r in placed.groupBy("__part").agg(F.sum("__n").alias("n")).orderBy("__part").collect():
        ahead.append((r["__part"], total))
        total += r["n"]
    before = Window.partitionBy("__part").orderBy(group, "__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = reduce(lambda c, x: F.when(F.col("__part") == x[0], F.lit(x[1])).otherwise(c), ahead, F.lit(0)) if len(ahead) <= 64 else F.element_at(F.create_map(*[F.lit(y) for x in ahead for y in x]), F.col("__part"))
    base = placed.select(F.col(group).alias("__group"), F.col("__cell").alias("__at"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) + base).cast("long").alias("__base"))
    inside = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(order)) - 1
    joined = celled.withColumn("__i", inside).join(base, F.col(group).eqNullSafe(F.col("__group")) & F.col("__cell").eqNullSafe(F.col("__at")))
    return joined.withColumn(name, F.col("__base") + F.col("__i")).drop("__i", "__base", "__group", "__at", "__cell")


def placed(rows: DataFrame, group: str, orders: Sequence[str], cell: Column, name: str) -> DataFrame:
    """Add the place of each row in its group, from 0, by ``orders``.

    ``cell`` is a coarser form of the first of them, so a group lies over as many tasks as it has cells. Rows are
    exchanged once, by group and cell; the numbers of rows in the cells before are added.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    keyed = rows.withColumns({"__group": text(F.col(group)), "__cell": cell, "__at": text(cell)})
    counts = keyed.groupBy("__group", "__cell", "__at").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__group", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__group", "__at").orderBy(*orders)) - 1
    joined = keyed.withColumn("__i", inside).join(base, ["__group", "__at"])
    return joined.withColumn(name, F.col("__base") + F.col("__i")).drop("__group", "__cell", "__at", "__i", "__base")


def with_previous(rows: DataFrame, group: str, order: str, column: str, name: str, size: int) -> DataFrame:
    """Add the value of ``column`` in the row whose ``order`` is one less, null without one.

    Groups are cut into cells of ``size`` places; the last row of a cell also goes to
    the next one, so that a long group is dealt over many tasks.
    """
    last = F.pmod(F.col(order), F.lit(size)) == size - 1
    cell = F.floor(F.col(order) / size)
    spread = rows.withColumn("__cell", F.explode(F.when(last, F.array(cell, cell + 1)).otherwise(F.array(cell))))
    near = Window.partitionBy(group, "__cell").orderBy(order)
    value = F.when(F.lag(order).over(near) == F.col(order) - 1, F.lag(column).over(near))
    return spread.withColumn(name, value).where(F.col("__cell") == cell).drop("__cell")
