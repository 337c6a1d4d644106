"""Hard filters with an audit.  A listing fails only what it is known to violate: unknown values pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fixed, signals, text
from ..functions.geo import box_around, haversine_km, in_box
from .constraints import Constraints, Layout

RESIDENTIAL = "|".join(fixed.NON_RESIDENTIAL)


def _known(violated: Column) -> Column:
    return F.coalesce(violated, F.lit(False))


def residential(df: DataFrame) -> DataFrame:
    """Listings that are homes; others leave no audit row."""
    return df.filter(~F.lower(text.safe_text(F.col("property_type"))).rlike(RESIDENTIAL))


def layout_failures(option: Layout, c: Constraints) -> list[Column]:
    """Reasons (null where met or unknown) why a listing isn't of a layout."""
    kind = F.lower(text.safe_text(F.col("property_type")))
    bed, bath, price = (text.to_float(F.col(x)) for x in ("bedrooms", "bathrooms", "price_pcm"))
    rent = option.max_rent if option.max_rent is not None else c.max_rent
    out = []
    if option.bedrooms is not None:
        out.append(F.when(_known(F.rint(bed) != option.bedrooms), "bedrooms"))
    if option.bathrooms is not None:
        out.append(F.when(_known(bath != option.bathrooms), "bathrooms"))
    if option.property_type:
        out.append(F.when((kind != "") & (kind != option.property_type.lower()), "property_type"))
    if option.tag == "studio":
        studio = (kind == "studio") | (kind.isin("flat", "apartment", "studio") & _known(F.rint(bed) == 0))
        out.append(F.when(~studio, "layout_tag"))
    if rent is not None:
        out.append(F.when(_known(price > rent), "price"))
    return out


def any_layout(c: Constraints) -> Column:
    """Whether one layout at least is met."""
    passed = [reduce(lambda a, b: a & b, [x.isNull() for x in layout_failures(o, c)], F.lit(True)) for o in c.layouts]
    return reduce(lambda a, b: a | b, passed)


def violations(c: Constraints, columns: list[str], as_of: str) -> dict[str, Column]:
    """For each active constraint, whether a listing is known to violate it."""
    out: dict[str, Column] = {}
    if c.layouts:
        out["layout_options"] = ~any_layout(c)
    elif c.max_rent is not None:
        out["price"] = text.to_float(F.col("price_pcm")) > c.max_rent
    if c.available_from is not None:
        listed = F.col("available_from")
        out["available_from"] = ~dates.is_now(listed) & (dates.available_from(listed, as_of) > F.lit(c.available_from).try_cast("date"))
    if c.furnish_type:
        have, want = text.furnishing(F.col("furnish_type")), text.furnishing(F.lit(c.furnish_type))
        out["furnish_type"] = (have != "") & ~have.isin("ask agent", "flexible") & (have != want)
    if c.let_type:
        have = text.category(F.col("let_type"))
        out["let_type"] = (have != "") & (have != text.category(F.lit(c.let_type)))
    if c.min_tenancy_months is not None:
        out["min_tenancy"] = text.months(F.col("min_tenancy")) > c.min_tenancy_months
    if c.min_size_sqm is not None:
        out["size_sqm"] = text.size_sqm(F.col("size_sqm"), F.col("size_sqft")) < c.min_size_sqm
    for name, wanted in c.bool_preferences.items():
        out[f"bool_{name}"] = signals.bool_signal(name, columns) != wanted
    return {k: _known(v) for k, v in out.items()}


def audit(df: DataFrame, c: Constraints, as_of: str) -> DataFrame:
    """Homes with ``reasons`` (violated constraints, in order), ``checks`` and ``hard_pass``."""
    failed = violations(c, df.columns, as_of)
    reasons = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in failed.items()))) if failed else F.array().cast("array<string>")
    checks = F.struct(*((~v).alias(k) for k, v in failed.items())) if failed else F.struct(F.lit(True).alias("none"))
    return residential(df).withColumns({"reasons": reasons, "checks": checks}).withColumn("hard_pass", F.size("reasons") == 0)


def hard_filter(df: DataFrame, c: Constraints, as_of: str) -> DataFrame:
    """Homes that violate nothing, as one plain filter."""
    return reduce(lambda d, v: d.filter(~v), violations(c, df.columns, as_of).values(), residential(df))


def location_filter(df: DataFrame, postcodes: list[str], stations: list[str], regions: list[str], anything: list[str]) -> DataFrame:
    """Listings with a token of any of the four families."""
    families = (("postcode_tokens", postcodes), ("station_tokens", stations), ("region_tokens", regions), ("tokens", anything))
    hits = [F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted))) for column, wanted in families if wanted]
    return df.filter(reduce(lambda a, b: a | b, hits)) if hits else df


def in_circle(df: DataFrame, lat: float, lng: float, radius_km: float, *, keep_unplaced: bool) -> DataFrame:
    """Listings within a circle: a cheap box first, then the exact distance.

    ``keep_unplaced``: rows without coordinates stay (a search by place alone) or go.
    """
    here = F.col("latitude"), F.col("longitude")
    near = in_box(*here, box_around(lat, lng, radius_km)) & (haversine_km(*here, F.lit(lat), F.lit(lng)) <= radius_km)
    return df.filter(near | (here[0].isNull() | here[1].isNull())) if keep_unplaced else df.filter(near)


def or_around(found: DataFrame, every: DataFrame, lat: float, lng: float, score: Column, n: int, key: str, *, radius_km: float = 3.0) -> DataFrame:
    """``found``; where it has no rows, of the n best of ``every`` (unfiltered) those around a place.

    This is what a search by the place's name falls back to when no listing has its token.
    ``found`` is asked for a single row; rows without coordinates are not around anything.
    """
    if not found.isEmpty():
        return found
    return in_circle(recall(every, score, n, key), lat, lng, radius_km, keep_unplaced=False).select(*found.columns)


def in_districts(df: DataFrame, districts: list[str], *, district: str = "postcode_district") -> DataFrame:
    """Listings of some districts, whatever their case; all listings where none is named."""
    wanted = [d.strip().upper() for d in districts if d.strip()]
    return df.filter(F.upper(F.trim(district)).isin(wanted)) if wanted else df


def recall(df: DataFrame, score: Column, n: int, key: str) -> DataFrame:
    """The n best rows by a score, before any filter (a later filter never moves below this limit)."""
    return df.withColumn("recall_score", score).orderBy(F.desc("recall_score"), key).limit(n)
