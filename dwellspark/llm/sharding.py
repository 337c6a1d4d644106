"""Sharding by longest-processing-time scheduling.

Rows with equal texts (by 128-bit hashes) are a group that stays together.  Groups,
sorted by size, go to the least-loaded shard through a heap.  Every group is scheduled,
but the heap looks at counts: Spark counts the groups of each size, and all groups of
one size are dealt at once, as one after the other would be.  The counts are what the
driver holds; as sizes differ by a byte at least, there are at most sqrt(2 * total bytes)
of them whatever the groups (250,000 for 30 GB), 16 bytes each.

For each size the plan has how many of its groups go to each shard.  Groups are ranked
within (size, salt), shifted by the counts of lower salts, and joined to the plan by their
size; rows are joined to their groups.  These are plain joins that Spark can split.
Slots are numbered within (shard, salt) in the same way, so no task holds a size or a shard.

Null and empty texts have no bytes and form one group.  Repeated rows get a slot each.
With fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_shared

SHARDS = 24
#: Bytes of a row besides its text.
ROW_BYTES = 8
SALT_ROWS = 100_000
LEAST_SALTS = 64


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, if each goes to the least-loaded one (ties: the lower).

    A shard takes groups at its load, its load + size, and so on; the ``count`` smallest
    of these places, of all shards, are taken.
    """
    taken = lambda level: [max(0, (level - x) // size + 1) if level >= x else 0 for x in loads]
    low, high = min(loads) - 1, min(loads) + size * count  # taken(low) <= count < taken(high) + 1
    while high - low > 1:
        level = (low + high) // 2
        if sum(taken(level)) <= count:
            low = level
        else:
            high = level
    out = taken(low)
    heap = [(x + n * size, k) for k, (x, n) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):  # fewer than shards
        at, k = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (at + size, k))
    return out


def longest_first(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """size and the number of its groups on each shard, for (size, number of groups), largest first."""
    loads = [0] * shards
    out = []
    for size, count in sorted(sizes, reverse=True):
        if count == 1:
            own = [0] * shards
            own[loads.index(min(loads))] = 1
        else:
            own = deal(loads, size, count)
        loads = [x + n * size for x, n in zip(loads, own, strict=True)]
        out.append((size, own))
    return out


def _numbered(rows: DataFrame, part: str, salt_of: tuple[str, ...], order: tuple[str, ...], number: str, count: int) -> DataFrame:
    """``rows`` (which must be stored) with their number (from 0) within ``part``."""
    salts = max(LEAST_SALTS, count // SALT_ROWS)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)))
    counts = salted.groupBy(part, "salt").agg(F.count("*").alias("n"))
    lower = Window.partitionBy(part).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(part, "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("base"))
    within = Window.partitionBy(part, "salt").orderBy(*order)
    placed = salted.withColumn("place", F.row_number().over(within) - 1).join(base, [part, "salt"])
    return placed.select(*rows.columns, (F.col("place") + F.col("base")).alias(number))


def shard(docs: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    size = (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long")
    rows, _ = write_shared(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")), "sizes")
    groups, _ = write_shared(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    found = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()  # at most sqrt(2 * total bytes) rows
    sizes = list(zip(found["bytes"].to_pylist(), found["n"].to_pylist(), strict=True))
    plan = longest_first(sizes, shards)
    ends = pa.array([np.cumsum(n).tolist() for _, n in plan], pa.list_(pa.int64()))
    of_size = spark.createDataFrame(pa.table({"bytes": pa.array([x for x, _ in plan], pa.int64()), "ends": ends}))
    ranked = _numbered(groups, "bytes", ("k1", "k2"), ("k1", "k2"), "rank", sum(n for _, n in sizes))
    home = ranked.join(of_size, "bytes").select("k1", "k2", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    home, _ = write_shared(home, "homes")
    placed, _ = write_shared(rows.join(home, ["k1", "k2"]), "placed")
    slots = _numbered(placed, "shard", ("doc_id", "text_crc32"), ("doc_id", "text_crc32", "k1", "k2"), "slot", rows.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
