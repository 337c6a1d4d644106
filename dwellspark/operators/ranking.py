"""The weighted ranking of listings that passed the hard filters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed, signals, text
from .constraints import Constraints


def weights(c: Constraints) -> dict[str, float]:
    transit, school = bool(c.transit_terms), bool(c.school_terms)
    base = {(True, True): (0.45, 0.35, 0.20, 0.35), (True, False): (0.65, 0.0, 0.35, 0.30), (False, True): (0.0, 0.65, 0.35, 0.30), (False, False): (0.0, 0.0, 0.30, 0.20)}[transit, school]
    return dict(
        zip(("transit", "school", "preference", "penalty"), base, strict=True), deposit=fixed.DEPOSIT_WEIGHT, freshness=fixed.FRESHNESS_WEIGHT, budget_headroom=fixed.HEADROOM_WEIGHT, bool_match=fixed.BOOL_WEIGHT if c.bool_preferences else 0.0
    )


def deposit_score(deposit: Column, price: Column) -> Column:
    """Lower deposits score higher, relative to the rent if it is known."""
    raw = text.safe_text(deposit)
    amount = F.when(F.lower(raw).isin(*fixed.UNKNOWN_CATEGORY), None).otherwise(text.first_number(F.regexp_replace(raw, ",", "")))
    rent = text.to_float(price)
    scored = F.when(rent > 0, F.exp(-(amount / rent) / fixed.DEPOSIT_RATIO_TAU)).otherwise(F.exp(-amount / fixed.DEPOSIT_TAU))
    return F.coalesce(scored, F.lit(fixed.MISSING_SCORE))


def freshness_score(added: Column, as_of: str) -> Column:
    return F.coalesce(F.exp(F.lit(-math.log(2.0) / fixed.HALF_LIFE_DAYS) * dates.age_days(added, as_of)), F.lit(fixed.MISSING_SCORE))


def headroom_score(price: Column, budget: float | None) -> Column:
    if budget is None or budget <= 0:
        return F.lit(0.0)
    return F.coalesce(F.greatest((F.lit(float(budget)) - text.to_float(price)) / budget, F.lit(0.0)), F.lit(0.0))


def unknown_fields(c: Constraints, as_of: str) -> dict[str, Column]:
    """Active constraints whose value a listing doesn't tell."""
    number = lambda x: text.to_float(F.col(x)).isNull()
    asked = lambda f: any(getattr(o, f) not in (None, "") for o in c.layouts)
    out = {}
    if c.max_rent is not None or asked("max_rent"):
        out["price"] = number("price_pcm")
    for name in ("bedrooms", "bathrooms"):
        if asked(name):
            out[name] = number(name)
    if asked("property_type"):
        out["property_type"] = text.safe_text(F.col("property_type")) == ""
    if c.available_from is not None:
        out["available_from"] = dates.available_from(F.col("available_from"), as_of).isNull()
    if c.furnish_type:
        out["furnish_type"] = text.furnishing(F.col("furnish_type")).isin("", "ask agent")
    if c.let_type:
        out["let_type"] = text.safe_text(F.col("let_type")) == ""
    if c.min_tenancy_months is not None:
        out["min_tenancy_months"] = text.months(F.col("min_tenancy")).isNull()
    if c.min_size_sqm is not None:
        out["min_size_sqm"] = text.size_sqm(F.col("size_sqm"), F.col("size_sqft")).isNull()
    return out


def unknown_penalty(c: Constraints, as_of: str) -> Column:
    sums = [F.when(v, fixed.UNKNOWN_PENALTIES[k]).otherwise(0.0) for k, v in unknown_fields(c, as_of).items()]
    return F.least(reduce(lambda a, b: a + b, sums, F.lit(0.0)), F.lit(fixed.UNKNOWN_PENALTY_CAP))


def bool_match_score(c: Constraints, columns: list[str]) -> Column:
    if not c.bool_preferences:
        return F.lit(0.0)
    hits = [F.when(F.coalesce(signals.bool_signal(n, columns) == want, F.lit(False)), 1.0).otherwise(0.0) for n, want in c.bool_preferences.items()]
    return reduce(lambda a, b: a + b, hits) / len(hits)


def match_pct(c: Constraints, columns: list[str], transit: Column, school: Column) -> Column:
    """How much of what was asked softly is met, 50 to 100 (an unknown preference counts half)."""
    met, total = [], 0.0
    for name, want in c.bool_preferences.items():
        w = 25.0 / len(c.bool_preferences)
        said = signals.bool_signal(name, columns)
        met.append(F.when(said.isNull(), w * 0.5).when(said == want, w).otherwise(0.0))
        total += w
    for terms, score in ((c.transit_terms, transit), (c.school_terms, school)):
        if terms:
            met.append(F.when(score > 0.1, 15.0).otherwise(0.0))
            total += 15.0
    if c.furnish_type:
        met.append(F.when(text.furnishing(F.col("furnish_type")) == text.furnishing(F.lit(c.furnish_type)), 8.0).otherwise(0.0))
        total += 8.0
    if not met:
        return F.lit(100)
    return F.greatest(F.least(F.rint(reduce(lambda a, b: a + b, met) * 100.0 / total), F.lit(100.0)), F.lit(50.0)).cast("int")


def location_hits(c: Constraints, column: Column) -> Column:
    hits = [F.when(F.lower(column).contains(p), 1).otherwise(0) for p in c.locations]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def rank(df: DataFrame, c: Constraints, as_of: str, *, key: str = "listing_id") -> DataFrame:
    """Scores and ``final_score``; columns transit_score, school_score, preference_score are used where they exist."""
    given = lambda n: F.col(n) if n in df.columns else F.lit(0.5 if n == "preference_score" else 0.0)
    w = weights(c)
    place = F.concat_ws(" ", *(F.col(x) for x in ("address", "stations", "postcode_district") if x in df.columns))
    missing = [F.when(~F.col(f).isNotNull() | (F.size(text.jsonish_items(F.col(f))) == 0), 0.12).otherwise(0.0) for f, terms in (("stations", c.transit_terms), ("schools", c.school_terms)) if terms and f in df.columns]
    scored = df.withColumns(
        {
            "transit_score": given("transit_score"),
            "school_score": given("school_score"),
            "preference_score": given("preference_score"),
            "deposit_score": deposit_score(F.col("deposit"), F.col("price_pcm")),
            "freshness_score": freshness_score(F.col("added_date"), as_of),
            "budget_headroom_score": headroom_score(F.col("price_pcm"), c.max_rent),
            "bool_match_score": bool_match_score(c, df.columns),
            "penalty_score": reduce(lambda a, b: a + b, missing, unknown_penalty(c, as_of)),
            "location_hit_count": location_hits(c, place),
        }
    )
    final = sum((F.lit(w[n]) * F.col(f"{n}_score") for n in ("school", "preference", "deposit", "freshness", "budget_headroom", "bool_match")), F.lit(w["transit"]) * F.col("transit_score"))
    return scored.withColumns({"final_score": final - F.lit(w["penalty"]) * F.col("penalty_score"), "match_pct": match_pct(c, df.columns, F.col("transit_score"), F.col("school_score"))})


def top(df: DataFrame, k: int, *, key: str = "listing_id", digits: int = 9) -> DataFrame:
    """The k best rows with their 1-based rank; the last tie is broken by key."""
    order = [F.round("final_score", digits).desc(), F.desc("location_hit_count"), F.asc(key)]
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of an ordered result, and whether more follow (``has_more``)."""
    rows = df.orderBy(*order).offset(number * size).limit(size + 1)
    n = F.row_number().over(Window.orderBy(*order))  # size + 1 rows
    return rows.withColumn("place", n).withColumn("has_more", F.max("place").over(Window.partitionBy()) > size).filter(F.col("place") <= size)


def commute_adjusted(pct: Column, minutes: Column) -> Column:
    drop = F.when(minutes.isNull(), 5).when(minutes <= 30, 0).when(minutes <= 45, 7).otherwise(15)
    return F.greatest(pct - drop, F.lit(50))
