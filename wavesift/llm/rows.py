"""Row-aligned Arrow maps: each input row gives one output row."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm.textops import SLICE_BYTES, slices
from wavesift.llm.workers import mapped


def with_columns(
    df: DataFrame,
    column: str,
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.RecordBatch], Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
    keeps: str | None = None,
) -> DataFrame:
    """Add ``fields`` to ``keep`` (default: all columns), computed from slices of rows.

    ``make`` runs once in each task and returns the function of a slice. An input
    column with the name of an added one, in any case, is replaced. ``keeps`` is what a
    worker may hold from task to task.
    """
    new = {name.lower() for name, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    # Arrow maps can't take names with dots and the like, so such columns have others on the way
    own = {c: c if c == column or re.fullmatch(r"\w+", c) else f"__c{i}" for i, c in enumerate(kept)}
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for c, n in own.items()), *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, column, slice_bytes):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in own.values()), *compute(part)], names=schema.names)

    given = df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in ({column: column} | own).items()])
    out = mapped(given, run, schema, keeps)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], *(n for n, _ in fields))


def renamed(keep: Sequence[str], text: str, fields: Sequence[tuple[str, T.DataType]]) -> dict[str, str]:
    """Names of their own for the columns to keep, but for those that ``fields`` replace; the text keeps its name."""
    new = {name.lower() for name, _ in fields}
    return {c: text if c == text else f"__in{i}" for i, c in enumerate(keep) if c.lower() not in new}


def join_keys(keys: Sequence[Column]) -> list[Column]:
    """Two keys as __a and __b; rows without any get one of their own, so that they don't meet in one task."""
    return [F.coalesce(keys[0], F.monotonically_increasing_id()).alias("__a"), keys[1].alias("__b")]


def guarded(df: DataFrame, plain: Sequence[str]) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df with all columns but ``plain`` renamed, their names, and the way back to df's columns.

    So no column of an operator meets one of the input.
    """
    inner = {c: c if c in plain else f"__in{i}" for i, c in enumerate(df.columns)}
    quote = lambda c: f"`{c.replace('`', '``')}`"
    renamed = df.select(*[F.col(quote(c)).alias(n) for c, n in inner.items()])
    return renamed, list(inner.values()), lambda out: out.select(*[F.col(n).alias(c) for c, n in inner.items()])
