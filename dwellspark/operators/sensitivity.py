"""Why a search found little, and what would find more: aggregates over one audited frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET_STEPS = (1.15, 1.25, 1.5)


def top_failures(audited: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent first reasons (ties by name)."""
    first = audited.filter("not hard_pass").select(F.split(F.get("reasons", F.lit(0)), " ")[0].alias("reason"))
    return first.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def near_misses(audited: DataFrame) -> DataFrame:
    return audited.filter(F.size("reasons") == 1)


def single_misses(audited: DataFrame) -> DataFrame:
    """For each constraint, the listings that fail it alone."""
    return near_misses(audited).groupBy(F.get("reasons", F.lit(0)).alias("reason")).agg(F.count("*").alias("n"))


def budget_sensitivity(df: DataFrame, budget: float, same: Column, price: str = "price_pcm") -> DataFrame:
    """One pass: listings gained by each larger budget, and the first step that gains any."""
    gains = [F.count_if(same & (F.col(price) > budget) & (F.col(price) <= F.rint(F.lit(budget * f)))).alias(f"gain_{int(round(f * 100))}") for f in BUDGET_STEPS]
    out = df.agg(*gains)
    first = F.coalesce(*(F.when(F.col(f"gain_{int(round(f * 100))}") > 0, F.lit(f)) for f in BUDGET_STEPS))
    return out.withColumn("first_step", first)


def layout_sensitivity(df: DataFrame, budget: float, bedrooms: int, order: str, n: int = 2) -> DataFrame:
    """Other numbers of bedrooms within the budget, most listings first (ties: first seen)."""
    other = df.filter((F.col("price_pcm") <= budget) & (F.col("bedrooms") != bedrooms))
    return other.groupBy("bedrooms").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n).select("bedrooms", "n")


def compare_areas(df: DataFrame, area: str, value: str) -> DataFrame:
    """count, least, exact median and largest value of each area."""
    return df.groupBy(area).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def insight(df: DataFrame, budget: float, price: str = "price_pcm") -> DataFrame:
    p = F.col(price)
    return df.agg(F.count("*").alias("n"), F.min(p).alias("least"), F.max(p).alias("most"), F.count_if(p <= budget).alias("within"))


def decide(found: int, prefiltered: int | None, attempts: int, wanted: int = 10, most_attempts: int = 2) -> str:
    """done, relax or ask: nothing near the place asks; too few results relax, a bounded number of times."""
    if found >= wanted:
        return "done"
    if prefiltered == 0:
        return "ask"
    return "relax" if attempts < most_attempts else ("done" if found else "ask")


def compare_rows(df: DataFrame, key: str, fields: list[str], *, most: int = 100) -> DataFrame:
    """Listings side by side: one row a field, one column a listing.  More than ``most`` listings are an error."""
    ids = sorted(r[0] for r in df.select(key).distinct().limit(most + 1).collect())
    if len(ids) > most:
        raise ValueError(f"more than {most} listings to compare")
    long = df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, fields, "field", "value")
    return long.groupBy("field").pivot(key, ids).agg(F.first("value"))


def ranked_within(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n best rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
