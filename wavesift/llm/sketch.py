"""Count-min sketches built per partition, merged by blocks and shared with all tasks.

A task keeps one byte per cell, saturating at ``cap``, and emits its non-empty blocks
compressed. Blocks of the same cells are added in rounds of ``FAN_IN``, so no merge task
holds more than two blocks at a time and none reads more than ``FAN_IN`` of them in the
early rounds. An estimate never falls below the true count (up to ``cap``). The number of
cells follows the expected number of items up to ``MAX_BITS``; beyond, estimates only get
looser, and whoever uses them stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm.textops import mix, slices
from wavesift.llm.workers import mapped

BLOCK = 1 << 20
FAN_IN = 64
MIN_BITS, MAX_BITS = 16, 27
#: Counts that a packed sketch tells apart; a cell holds the last one not above its count.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192], np.uint8)


def bits_for(items: float) -> int:
    """Cells per row for so many items, as a power of two; bounded by MAX_BITS."""
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(items, 1) * 2))))


class Sketch:
    """Merged sketch: rows of 2**bits cells, each one bit ("two or more") or four (a level)."""

    def __init__(self, cells: np.ndarray, bits: int, single: bool):
        self.cells, self.bits, self.single = cells, bits, single

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash (with single bits 2 for repeated, else 1)."""
        best = None
        for r in range(len(self.cells)):
            at = _cell(hashes, r, self.bits)
            if self.single:
                got = ((self.cells[r][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) + 1
            else:
                got = LEVELS[(self.cells[r][at >> np.uint64(1)] >> (4 * (at & np.uint64(1))).astype(np.uint8)) & 15]
            best = got if best is None else np.minimum(best, got)
        return best


def _cell(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    spread = mix(hashes ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95 * (row + 1) & (1 << 64) - 1))
    return spread >> np.uint64(64 - bits)


def _add(cells: np.ndarray, at: np.ndarray, cap: int) -> None:
    at = np.sort(at)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(first, len(at))), cap).astype(np.uint16)
    at = at[first]
    cells[at] = np.minimum(cells[at] + count, cap)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Levels of counts, two in a byte."""
    level = (np.searchsorted(LEVELS, counts, "right") - 1).astype(np.uint8)
    return level[0::2] | (level[1::2] << 4)


def _merger(merge, last: bool):
    return lambda pdf: merge(pdf, last)


def build(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]],
    bits: int,
    rows: int = 2,
    cap: int = 2,
) -> Sketch:
    """Sketch of the hashes that ``make()`` gives for each slice of df."""
    block = min(BLOCK, 1 << bits)

    def count(batches):
        hashes_of = make()
        cells = np.zeros((rows, 1 << bits), np.uint8)
        for batch in batches:
            for part in slices(batch, column):
                h = hashes_of(part)
                for r in range(rows):
                    _add(cells[r], _cell(h, r, bits), cap)
        pack = zstandard.ZstdCompressor(level=1)
        flat = cells.reshape(-1, block)
        for b in np.flatnonzero(flat.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack.compress(flat[b].tobytes())], pa.binary())], names=["block", "cells"])

    single = cap == 2

    def merge(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(block, np.uint8)
        for raw in pdf["cells"]:
            got = np.frombuffer(unpack.decompress(raw), np.uint8)
            # both are at most cap, and so their sum fits
            total = np.minimum(total + np.minimum(got, cap - total), cap)
        if last:
            cells = np.packbits(total > 1, bitorder="little") if single else _levels(total)
            raw = cells.tobytes()
        else:
            raw = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "lane": pdf["lane"].iloc[:1], "cells": [raw]})

    merged = mapped(df.select(column), count, "block int, cells binary").withColumn("lane", F.spark_partition_id())
    tasks = df.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN_IN)
        last = tasks <= 1
        merged = merged.withColumn("lane", (F.col("lane") / FAN_IN).cast("int"))
        merged = merged.groupBy("block", "lane").applyInPandas(_merger(merge, last), "block int, lane int, cells binary")
        if last:
            break

    per_byte = 8 if single else 2
    cells = np.zeros((rows << bits) // per_byte, np.uint8)
    size = block // per_byte
    # bounded: rows * 2**MAX_BITS cells at most
    for r in merged.select("block", "cells").toLocalIterator():
        cells[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(r.cells), np.uint8)
    return Sketch(cells.reshape(rows, -1), bits, single)


class KeySet:
    """Bits of a set of keys: holds every key put in, and few others."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = _cell(keys, 0, self.width)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def build_set(df: DataFrame, column: str) -> KeySet:
    """Bit set of a long column; its width follows the row count up to MAX_BITS.

    Each bit's row comes to the driver as 64 bits of a distinct word, at most
    2**(MAX_BITS - 6) words.
    """
    width = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(df.count(), 1) * 16))))

    def cells(batches):
        for batch in batches:
            at = np.unique(_cell(batch.column(column).to_numpy().view(np.uint64), 0, width))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = mapped(df.select(column), cells, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(max(1, (1 << width) // 64), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return KeySet(bits.view(np.uint8), width)
