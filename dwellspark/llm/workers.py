"""Running Arrow functions in bounded memory.

A Python worker serves many stages.  What one of them has held and freed stays with
the process, on top of what the next one needs, unless it is given back; and a batch of
Spark's usual size is large if its rows are whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship_package
from . import wordhash

#: Rows and bytes of an Arrow batch, and Spark's own values, which are replaced; others, that a session sets, stay.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("2000", ("10000",)),
    "spark.sql.execution.arrow.maxBytesPerBatch": (str(2 << 20), ("67108864", "67108864b", "64m", "64MB")),
}

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: glibc's numbers of the settings below, and from what size on memory is mapped by itself.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, M_ARENA_MAX = -1, -3, -8
MAPPED = 128 << 10


@cache
def bound_memory() -> None:
    """Let large arrays go back to the system when they are freed: the limit from which they are mapped otherwise grows with use, and Arrow's own pool keeps what it had."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        for name, value in ((M_MMAP_THRESHOLD, MAPPED), (M_TRIM_THRESHOLD, MAPPED), (M_ARENA_MAX, 1)):
            libc.mallopt(name, value)
    except (AttributeError, OSError):  # not a glibc system
        pass


def release_memory() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a glibc system
        pass


def map_batches(df: DataFrame, run: Batches, schema: str | StructType, *, bounded: bool = True) -> DataFrame:
    """``df.mapInArrow``, with small batches, and freed memory given back after each partition.

    ``bounded`` gives large arrays back at once, for about a third more CPU time (measured in the pipeline's stages).
    """
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    for name, (own, sparks) in BATCH.items():
        if conf.get(name, sparks[0]) in sparks:
            conf.set(name, own)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bounded:
            bound_memory()
        yield from run(batches)
        wordhash.forget_powers()
        release_memory()

    return df.mapInArrow(tidied, schema)
