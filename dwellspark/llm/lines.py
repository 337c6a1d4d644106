"""Line dedup by site-relative frequency.

A line is boilerplate on a host if more than ``ratio`` of the host's pages hold it, and
two pages at least (a line of one page repeats nothing).  Lines are compared without
surrounding spaces, by 128-bit hashes; a page counts a line once.  Boilerplate lines are
dropped from all pages of the host, whatever is left of them.

Only DataFrame functions are used.  Counts are partial sums over (host, hash of line),
so a host or line with a third of all rows is combined before the shuffle.  Texts
aren't shuffled: a host has at most (distinct lines a page) / ratio boilerplate lines,
which join its pages as one array.  That table is broadcast up to ``BROADCAST_LINES``
lines (16 bytes each); beyond, pages and table are joined on (host, salt).

Null texts have no lines and stay null; empty lines are kept and never counted.  Null
hosts are one host.  Repeated rows count as pages of their own.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Packed, write_shared

RATIO = 0.1
LEAST_PAGES = 2
BROADCAST_LINES = 1_000_000
SALTS = 64


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case and without a port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, *, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and lines (array of hashes) for each host of ``pages`` (host, text) with boilerplate."""
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _hash))
    counts = pages.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    often = counts.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def cleaned_pages(docs: DataFrame, *, source: str = "source", text: str = "text", is_url: bool = False, ratio: float = RATIO, broadcast_lines: int = BROADCAST_LINES) -> tuple[Packed, DataFrame]:
    """``docs`` packed, and their rows with after (the text without boilerplate), n_lines and n_dropped (long).

    The host is the column ``source``, or that of the URL in it.
    """
    packed = Packed(docs)
    site = packed.field(source).cast("string")
    pages = packed.rows.select("row", F.coalesce(host_of(site) if is_url else site, F.lit("\0")).alias("host"), packed.field(text).cast("string").alias("text"))
    found, _ = write_shared(boilerplate(pages.select("host", "text"), ratio=ratio), "boilerplate")
    if found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0] <= broadcast_lines:
        joined = pages.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    left = F.filter(_lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains("lines", _hash(x)))
    cut = joined.select("row", "text", F.when(F.col("lines").isNotNull(), left).otherwise(_lines(F.col("text"))).alias("left"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    n_left = F.when(F.col("text").isNull(), 0).otherwise(F.size("left")).cast("long")
    return packed, cut.select("row", F.array_join("left", "\n").alias("after"), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"))


def drop_boilerplate(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, and n_lines and n_dropped, which replace columns of those names."""
    packed, cut = cleaned_pages(docs, text=text, **options)
    own = packed.index(text)
    row = F.struct(*((F.col("after") if i == own else F.col("row")[f"c{i}"]).alias(f"c{i}") for i in range(len(packed.names))))
    return packed.unpack_with(cut.withColumn("row", row), n_lines=F.col("n_lines"), n_dropped=F.col("n_dropped"))


def without_boilerplate(docs: DataFrame, *, text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``; ``length``, if there is such a column, follows the text."""
    packed, cut = cleaned_pages(docs, text=text, **options)
    changed = {text: F.col("after")}
    if length in packed.names:
        kind = docs.schema.fields[packed.index(length)].dataType
        changed[length] = F.when(F.col("n_dropped") > 0, F.length("after").cast(kind)).otherwise(packed.field(length))
    return packed.unpack(cut, **changed)
