"""Looking over results and requests: arbitration, changes of lists, shortlists, open points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text


def arbitrate(df: DataFrame, fields: dict[str, tuple[str, str]], policy: str = "HYBRID", high_risk: tuple[str, ...] = X.HIGH_RISK_FIELDS) -> DataFrame:
    """One value a field out of two readings (a model's and the rules'), with n_agreed, agreement and conflicts.

    RULE_FIRST takes the rules' value.  LLM_FIRST takes the model's, but for fields of high
    risk where the rules have one.  HYBRID prefers the rules for fields of high risk and the
    model for others, and either where the other has none.
    """
    if policy not in ("RULE_FIRST", "HYBRID", "LLM_FIRST"):
        raise ValueError(f"unknown policy {policy}")
    chosen, same = {}, {}
    for name, (model, rule) in fields.items():
        m, r = F.col(model), F.col(rule)
        guarded = F.coalesce(r, m)
        first = {"RULE_FIRST": r, "LLM_FIRST": guarded if name in high_risk else m, "HYBRID": guarded if name in high_risk else F.coalesce(m, r)}[policy]
        same[name] = m.eqNullSafe(r)
        chosen[name] = F.when(same[name], m).otherwise(first)
    agreed = sum((s.cast("int") for s in same.values()), F.lit(0))
    results = {
        "n_agreed": agreed,
        "agreement": agreed / F.lit(float(max(len(fields), 1))),
        "conflicts": F.array_compact(F.array(*(F.when(~s, F.lit(n)) for n, s in same.items()))).cast("array<string>"),
    }
    return df.withColumns({**{n: c.alias(n) for n, c in chosen.items()}, **results})


def _norm(items: Column) -> Column:
    return F.transform(items, lambda x: F.lower(x))


def added(old: Column, new: Column) -> Column:
    """What a list has gained, whatever the case; null lists are empty."""
    before = _norm(F.coalesce(old, F.array().cast("array<string>")))
    return F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: ~F.array_contains(before, F.lower(x)))


def removed(old: Column, new: Column) -> Column:
    return added(new, old)


def united(a: Column, b: Column) -> Column:
    """Two lists in order, without what is the same place name as something before it."""
    none = F.array().cast("array<string>")
    items = F.filter(F.transform(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda x: F.trim(x)), lambda x: text.location_keyword(x) != "")
    keys = F.transform(items, text.location_keyword)
    return F.filter(items, lambda x, i: F.array_position(keys, text.location_keyword(x)) == i + 1)


def asks_across(said: Column) -> Column:
    """Whether a question is about several results ("which one", "which of", ...)."""
    return F.coalesce(F.lower(said).rlike(X.ACROSS_PATTERN), F.lit(False))


def restrictions(features: Column) -> Column:
    """The features that forbid something."""
    return F.filter(_stated(features), _forbids)


def amenities(features: Column) -> Column:
    """The features that don't."""
    return F.filter(_stated(features), lambda x: ~_forbids(x))


def _stated(features: Column) -> Column:
    return F.filter(features, lambda x: ~F.lower(F.trim(x)).isin(*X.UNSTATED_FEATURE))


def _forbids(x: Column) -> Column:
    low = F.lower(x)
    return ~F.trim(low).rlike(X.GOOD_NO_PATTERN) & low.rlike(X.FORBIDS_PATTERN)


def shortlisted(df: DataFrame, shortlist: DataFrame, *, key: str = "listing_id", other: str = "url") -> DataFrame:
    """``df`` with a flag: whether its key (or, without one, its other key) is on the shortlist (column ``key``)."""
    listed = shortlist.select(F.col(key).alias("_key")).distinct().withColumn("shortlisted", F.lit(True))
    own = F.coalesce(F.nullif(F.col(key), F.lit("")), F.col(other)) if other in df.columns else F.col(key)
    return df.withColumn("_key", own).join(listed, "_key", "left").withColumn("shortlisted", F.coalesce("shortlisted", F.lit(False))).drop("_key")


def _turned(items: Column, seed: Column) -> Column:
    """A list rotated left by the md5 of ``seed`` (as a number) modulo its length."""
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    hexes = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: digit(F.substr(F.md5(seed), i, F.lit(1))))
    by = F.aggregate(hexes, F.lit(0), lambda a, d: (a * 16 + d) % F.greatest(F.size(items), F.lit(1)))
    return F.when(F.size(items) < 2, items).otherwise(F.concat(F.slice(items, by + 1, F.size(items)), F.slice(items, F.lit(1), by)))


def open_points(unknown: dict[str, Column], seed: Column, *, most: int = 2, weights: dict[str, int] = X.POINT_WEIGHTS) -> Column:
    """The weightiest unknown points of a listing, those of one weight rotated by a hash of the listing."""
    levels = sorted({weights[p] for p in unknown}, reverse=True)
    bucket = lambda w: F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in unknown.items() if weights[p] == w))).cast("array<string>")
    return F.slice(F.concat(*(_turned(bucket(w), seed) for w in levels)), 1, most)


def ordered_risks(risks: Column, most: int = 3) -> Column:
    """Distinct risks, those about deposits last, at most ``most``."""
    items = F.filter(F.transform(risks, lambda x: F.trim(x)), lambda x: x != "")
    about = lambda x: F.lower(x).rlike(X.DEPOSIT_PATTERN)
    ordered = F.concat(F.filter(items, lambda x: ~about(x)), F.filter(items, about))
    keys = _norm(ordered)
    return F.slice(F.filter(ordered, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most)
