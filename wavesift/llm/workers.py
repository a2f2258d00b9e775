"""Arrow maps whose Python workers keep little: what one operator holds goes when another one begins.

Workers live on from stage to stage. So a tokenizer, a memo or a table of powers would
stay with every worker until the application ends, beside those of the next operator.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch on its way to a worker; Spark's own limit, where it is the default, is lowered to it.
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20

_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """What ``make`` gives, kept by the worker under ``key``, and nothing else beside it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _enter(keeps: str | None) -> None:
    if keeps not in _HELD:
        _HELD.clear()


def _give_back() -> None:
    """Free memory goes back to the system."""
    from wavesift.llm import textops

    textops.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _bytes(text: str) -> int:
    digits = text.lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits[:-1] if unit else digits) << unit


def mapped(df: DataFrame, function: Callable, schema, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow``; a task drops what the worker holds, unless it holds ``keeps``."""
    conf = df.sparkSession.conf
    if _bytes(conf.get(_BATCH_CONF)) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches):
        _enter(keeps)
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
