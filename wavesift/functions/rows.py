"""Matrix functions over an array column, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole(column: str) -> Column:
    """Whether an array is there and holds no null."""
    c = F.col(column)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull())


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _fit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Which rows are arrays of ``width`` values without nulls."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = size == width
    values = column.flatten()
    if values.null_count:
        null = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        end = np.cumsum(np.maximum(size, 0))
        good &= null[end] == null[end - np.maximum(size, 0)]
    return good


def with_matrix(df: DataFrame, column: str, name: str, function: Callable[[np.ndarray], np.ndarray], vector: bool, width: int) -> DataFrame:
    """Add ``name``: a vector (or number) for each row, from the batch's rows as a matrix.

    Rows whose array is null, holds a null or has another length than ``width`` get a
    null. A column of that name is replaced.
    """
    kind = T.ArrayType(T.DoubleType()) if vector else T.DoubleType()
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(column)
            good = _fit_rows(rows, width)
            if width and good.any():
                out = np.ascontiguousarray(function(matrix(rows.filter(pa.array(good)))), np.float64)
            else:
                good, out = np.zeros(len(good), bool), np.zeros((0, 0) if vector else 0)
            if vector:
                ends = np.concatenate([[0], np.cumsum(good * out.shape[1])]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~good))
            else:
                full = np.zeros(len(good))
                full[good] = out
                made = pa.array(full, mask=~good)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=schema.names)

    return df.mapInArrow(run, schema)


def moments(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their mean, and the sum of outer products around it, in one pass.

    Products are taken around one of the rows, so that large means lose no digits. Rows
    without a whole array of that row's length don't count; without any the arrays are
    empty. Each partition sends one row of sums for each dimension.
    """
    given = rows.where(whole(column)).select(F.col(column).cast("array<double>").alias("x"))
    one = given.first()
    if one is None or not one["x"]:
        return 0, np.empty(0), np.empty((0, 0))
    shift = np.array(one["x"])
    width = len(shift)

    def products(batches):
        n, line, total = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            good = _fit_rows(batch.column("x"), width)
            if good.any():
                x = matrix(batch.column("x").filter(pa.array(good))) - shift
                n, line, total = n + len(x), line + x.sum(0), total + x.T @ x
        if n:
            for at in range(0, width, 256):
                part = slice(at, min(at + 256, width))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"i": np.arange(width, dtype=np.int32)[part], "n": n, "s": line[part], "row": list(total[part])}), preserve_index=False)

    sums = given.mapInArrow(products, "i int, n long, s double, row array<double>")
    got = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), Summarizer.metrics("sum").summary(array_to_vector("row")).alias("p")).orderBy("i").collect()
    n, off = got[0]["n"], np.array([r["s"] for r in got]) / got[0]["n"]
    return n, shift + off, np.stack([r["p"]["sum"].toArray() for r in got]) - n * np.outer(off, off)
