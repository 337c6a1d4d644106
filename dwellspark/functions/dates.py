"""Dates in listings and requests.  "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import safe_text


def day_first(c: Column) -> Column:
    """ISO dates, else day/month/year (month first only if the second part is above 12; two-digit years are 20xx)."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\s*$", i), F.lit("")).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    day, month = F.when(part(2) > 12, part(2)).otherwise(part(1)), F.when(part(2) > 12, part(1)).otherwise(part(2))
    parts = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.coalesce(c.try_cast("date"), F.when(part(1).isNotNull(), parts.try_cast("date")), *(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("d MMMM yyyy", "d MMM yyyy")))


def is_now(c: Column) -> Column:
    return F.lower(safe_text(c)).isin(*X.NOW_WORDS)


def available_from(c: Column, as_of: str) -> Column:
    return F.when(is_now(c), F.lit(as_of).cast("date")).otherwise(day_first(safe_text(c)))


def age_days(c: Column, as_of: str) -> Column:
    """Days since a listing was added ('added today', 'yesterday', 'added on 05/01/2024'); null if it can't be told."""
    s = F.lower(safe_text(c))
    date = day_first(F.trim(F.regexp_replace(s, r"\b(added|on|reduced)\b", " ")))
    days = F.when(date.isNotNull(), F.greatest(F.datediff(F.lit(as_of).cast("date"), date), F.lit(0)))
    return F.when(s == "", None).when(s.isin("today", "added today"), 0).when(s.isin("yesterday", "added yesterday"), 1).otherwise(days)
