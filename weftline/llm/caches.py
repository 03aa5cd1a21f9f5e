"""Memory of Python workers: what one keeps from task to task, and how much it is sent at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.plans.workers import ensure_importable

Kept = TypeVar("Kept")
_kept: dict[Hashable, object] = {}

BATCH_KEY, DEFAULT_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def keep(key: Hashable, make: Callable[[], Kept]) -> Kept:
    """What was kept under this key, made anew if something else was kept since.

    A worker keeps one thing at a time, so that the stages of a job don't add up in its memory.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            trim()
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Give memory that was freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def bounded(df: DataFrame) -> DataFrame:
    """The table; from now on its session sends workers batches of 8 MB at most, unless it names a size itself, and they can import this package."""
    ensure_importable(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, DEFAULT_BATCH) == DEFAULT_BATCH:
        conf.set(BATCH_KEY, BATCH)
    return df
