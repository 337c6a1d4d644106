"""Queries of arbitration, changes of lists, shortlists and open points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import review
from .listing import WITH_LISTING, listings

SAID = (
    "Which one has a garden?",
    "is the second one furnished",
    "which listing is nearest to the station",
    "Tell me which   property allows pets",
    "which of these is cheapest",
    "whichever is fine",
)
RISKS = ("Deposit is not stated", " Size is not stated", "size is not stated", "", "Upfront costs unclear", "Lease unclear")


def shortlist_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir)
    return review.shortlisted(df, df.filter("k % 17 = 0").select("listing_id")).select("k", "shortlisted")


def field_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = listings(spark, sf_dir).selectExpr("k", *(f"{sql} as {name}" for name, sql in _READINGS.items()))
    out = review.arbitrate(read, {"furnish_type": ("m_furnish", "r_furnish"), "let_type": ("m_let", "r_let"), "bedrooms": ("m_beds", "r_beds")})
    return out.select("k", "furnish_type", "let_type", "bedrooms", "n_agreed", F.round("agreement", 6).alias("agreement"), F.array_join("conflicts", ",").alias("conflicts"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.split("p_name", " ").alias("old"), F.array(F.upper(F.element_at(F.split("p_name", " "), 1)), F.lit("South-Bank"), F.lit("south bank"), F.lit("")).alias("new"))


def list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, "|")
    df = _places(spark, sf_dir)
    return df.select("p_partkey", joined(review.added(F.col("old"), F.col("new"))).alias("added"), joined(review.removed(F.col("old"), F.col("new"))).alias("removed"))


def list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("p_partkey", F.array_join(review.united(F.col("old"), F.col("new")), "|").alias("places"))


def questions_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("event_id") % len(SAID)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", review.asks_across(said).alias("across"))


def feature_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.split(F.coalesce("features", F.lit("none")), ", ")
    return listings(spark, sf_dir).select("k", F.array_join(review.amenities(items), "|").alias("amenities"), F.array_join(review.restrictions(items), "|").alias("restrictions"))


def open_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = review.open_points({n: F.expr(sql) for n, sql in _POINTS.items()}, F.col("listing_id"))
    return listings(spark, sf_dir).select("k", F.array_join(points, ",").alias("points"))


def risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = F.filter(F.array(*map(F.lit, RISKS)), lambda x, i: (F.col("k") + i) % 3 != 0)
    return listings(spark, sf_dir).select("k", F.array_join(review.ordered_risks(risks), "|").alias("risks"))


_READINGS = {
    "m_furnish": "case when k % 4 = 0 then null else furnish_type end",
    "r_furnish": "case when k % 3 = 0 then 'furnished' when k % 3 = 1 then furnish_type end",
    "m_let": "let_type",
    "r_let": "case when k % 6 = 0 then 'short term' when k % 6 < 4 then let_type end",
    "m_beds": "bedrooms",
    "r_beds": "case when k % 5 = 0 then null when k % 5 = 1 then 1 else bedrooms end",
}
_UNKNOWN = ", ".join(f"'{v}'" for v in X.UNKNOWN_POINT)
_POINTS = {f: f"lower(trim(coalesce(cast({f} as string), ''))) in ({_UNKNOWN})" for f in ("bedrooms", "bathrooms", "available_from", "min_tenancy", "deposit", "furnish_type", "property_type")}
_POINTS["size"] = "size_sqm is null and size_sqft is null"


def _rotated(weight: int) -> str:
    """The SQL for one weight's points, rotated."""
    cases = ", ".join(f"case when {_POINTS[p]} then '{p}' end" for p in _POINTS if X.POINT_WEIGHTS[p] == weight)
    items = f"list_filter([{cases}], lambda x: x is not null)"
    by = f"list_reduce(list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', substr(md5(listing_id), i, 1)) - 1), lambda a, d: (a * 16 + d) % greatest(len({items}), 1))"
    return f"case when len({items}) < 2 then {items} else list_concat(list_slice({items}, {by} + 1, len({items})), list_slice({items}, 1, {by})) end"


_PLACES = "with p as (select p_partkey, string_split(p_name, ' ') as o, [upper(string_split(p_name, ' ')[1]), 'South-Bank', 'south bank', ''] as n from part)"
_LOW = "list_transform({}, lambda y: lower(y))"
_KEY = "trim(regexp_replace(replace(lower({}), '-', ' '), '\\s+', ' ', 'g'))"
_FEATURES = "list_filter(string_split(coalesce(features, 'none'), ', '), lambda x: lower(trim(x)) not in ('ask agent', 'n/a', 'none'))"
_FORBIDS = f"(not regexp_matches(trim(lower(x)), '{X.GOOD_NO_PATTERN}') and regexp_matches(lower(x), '{X.FORBIDS_PATTERN}'))"

QUERIES = {f.__name__: f for f in (shortlist_flags, field_arbitration, list_changes, list_union, questions_across, feature_split, open_points, risk_order)}

ORACLES = {
    "shortlist_flags": WITH_LISTING + " select k, k % 17 = 0 as shortlisted from listing",
    "field_arbitration": WITH_LISTING
    + ", r as (select k, "
    + ", ".join(f"{sql} as {name}" for name, sql in _READINGS.items())
    + """ from listing), s as (select *, m_furnish is not distinct from r_furnish as f, m_let is not distinct from r_let as l, m_beds is not distinct from r_beds as b from r)
        select k, coalesce(m_furnish, r_furnish) as furnish_type, coalesce(r_let, m_let) as let_type, coalesce(m_beds, r_beds) as bedrooms,
               f::int + l::int + b::int as n_agreed, round((f::int + l::int + b::int) / 3.0, 6) as agreement,
               concat_ws(',', case when not f then 'furnish_type' end, case when not l then 'let_type' end, case when not b then 'bedrooms' end) as conflicts
        from s""",
    "list_changes": _PLACES
    + f""" select p_partkey, array_to_string(list_filter(n, lambda x: not list_contains({_LOW.format("o")}, lower(x))), '|') as added,
                  array_to_string(list_filter(o, lambda x: not list_contains({_LOW.format("n")}, lower(x))), '|') as removed from p""",
    "list_union": _PLACES
    + f""", f as (select p_partkey, list_filter(list_concat(o, n), lambda x: trim(x) <> '') as a from p), g as (select *, list_transform(a, lambda x: {_KEY.format("x")}) as keys from f)
          select p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(keys, {_KEY.format("x")}) = i), '|') as places from g""",
    "questions_across": "select event_id, event_id % 6 in (0, 2, 3, 4) as across from events",
    "feature_split": WITH_LISTING
    + f" select k, array_to_string(list_filter({_FEATURES}, lambda x: not {_FORBIDS}), '|') as amenities, array_to_string(list_filter({_FEATURES}, lambda x: {_FORBIDS}), '|') as restrictions from listing",
    "open_points": WITH_LISTING
    + f" select k, array_to_string(list_slice(list_concat(list_concat({_rotated(4)}, {_rotated(3)}), list_concat({_rotated(2)}, {_rotated(1)})), 1, 2), ',') as points from listing",
    "risk_order": WITH_LISTING
    + """, r as (select k, list_filter(['Lease unclear', 'Size is not stated', 'Deposit is not stated', 'Upfront costs unclear'], lambda x: case x
                when 'Lease unclear' then (k + 5) % 3 <> 0 when 'Deposit is not stated' then k % 3 <> 0 when 'Upfront costs unclear' then (k + 4) % 3 <> 0 else (k + 1) % 3 <> 0 or (k + 2) % 3 <> 0 end) as a from listing)
        select k, array_to_string(list_slice(list_transform(list_concat(list_filter(a, lambda x: x like 'Size%'), list_concat(list_filter(a, lambda x: x like 'Lease%'),
               list_filter(a, lambda x: x like 'Deposit%' or x like 'Upfront%'))), lambda x: case when x like 'Size%' and (k + 1) % 3 = 0 then 'size is not stated' else x end), 1, 3), '|') as risks from r""",
}
