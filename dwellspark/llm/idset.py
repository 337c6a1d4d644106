"""Keeping texts out of shuffles: a bitmap of bounded size over hashed ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_shared

#: Bits of the bitmap, which is broadcast as at most BITS / 64 rows of 16 bytes; with far more ids than bits it lets all rows through to the join.
BITS = 1 << 25


def maybe_in(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose ``doc`` is surely not among ``ids``, and the others (nearly all of them among ids)."""
    place = F.pmod(F.xxhash64("doc"), F.lit(BITS))
    bits = ids.select(place.alias("p")).selectExpr("p div 64 as _word", "shiftleft(1L, cast(p % 64 as int)) as bit").groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    bitmap = F.broadcast(write_shared(bits, "bitmap")[0])
    looked_up = docs.withColumn("_place", place).withColumn("_word", F.expr("_place div 64")).join(bitmap, "_word", "left")
    held = F.expr("coalesce(shiftright(_bits, cast(_place % 64 as int)) & 1, 0) = 1")
    return looked_up.filter(~held).select(*docs.columns), looked_up.filter(held).select(*docs.columns)
