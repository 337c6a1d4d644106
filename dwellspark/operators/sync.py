"""Keeping the listings table current: key diffs, retention, partial updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_diff(old: DataFrame, new: DataFrame, key: str = "listing_id") -> DataFrame:
    """key and status: added, removed or kept.  One shuffle of keys alone."""
    o, n = old.select(key).distinct().withColumn("in_old", F.lit(True)), new.select(key).distinct().withColumn("in_new", F.lit(True))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("kept")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def incremental_sync(old: DataFrame, new: DataFrame, key: str = "listing_id") -> DataFrame:
    """The table after a sync by key: kept rows as they were, removed rows gone, added rows new."""
    kept = old.join(new.select(key).distinct(), key, "left_semi")
    added = new.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(old.select(key).distinct(), key, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def purge_stale(df: DataFrame, cutoff: str, column: str = "scraped_at") -> DataFrame:
    """Rows that weren't scraped before ``cutoff`` (ISO text, compared as text); rows without a time stay."""
    stale = (F.col(column) != "") & (F.col(column) < cutoff)
    return df.filter(~F.coalesce(stale, F.lit(False)))


def update_payload(df: DataFrame, updates: DataFrame, key: str, always: dict[str, str], if_missing: dict[str, str]) -> DataFrame:
    """Columns of ``updates`` (key, ...) put into ``df``: ``always`` where known, ``if_missing`` where df has none."""
    u = updates.dropDuplicates([key]).select(key, *(F.col(c).alias(f"u_{c}") for c in {*always.values(), *if_missing.values()}))
    values: dict[str, Column] = {c: F.coalesce(F.col(f"u_{s}"), F.col(c)) for c, s in always.items()}
    values |= {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"u_{s}")) for c, s in if_missing.items()}
    return df.join(u, key, "left").withColumns(values).select(*df.columns)


def with_discovery(df: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """All rows of ``df`` with the ``discovery_paths`` of their key, an empty list where none is known.

    ``paths`` has one row a key, as ``discovery`` gives it.
    """
    other = [c for c in df.columns if c != "discovery_paths"]
    attached = df.select(*other).join(paths.select(key, "discovery_paths"), key, "left")
    return attached.select(*other, F.coalesce("discovery_paths", F.array().cast("array<string>")).alias("discovery_paths"))


def discovery(found: DataFrame, key: str, order: str, url: str, query: str) -> DataFrame:
    """key, first url, and the distinct queries in order of discovery."""
    firsts = found.groupBy(key, query).agg(F.min(order).alias("_o"), F.min_by(url, order).alias("_url"))  # repeats go before anything is listed
    queries = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col(query).alias("q")))), lambda x: x["q"])
    return firsts.groupBy(key).agg(F.min_by("_url", "_o").alias("url"), queries.alias("discovery_paths"))
