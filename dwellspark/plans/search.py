"""Queries of hard filtering, sensitivity and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, matching, sensitivity
from ..operators.constraints import Constraints, Layout
from .listing import REGIONS, WITH_LISTING, listings, regions

AS_OF = "2024-01-15"
SEARCH = Constraints(
    max_rent=2200.0, available_from="2024-02-15", furnish_type="furnished", let_type="long term", min_tenancy_months=12, min_size_sqm=45.0, bool_preferences={"pets_allowed": True, "garden": True}
)
LAYOUTS = Constraints(max_rent=2600.0, layouts=(Layout(bedrooms=2, bathrooms=2.0), Layout(bedrooms=1, property_type="flat", max_rent=1500.0), Layout(tag="studio", max_rent=1800.0)))
CENTRE = (51.505, -0.115, 6.0)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(listings(spark, sf_dir), SEARCH, AS_OF)


def hard_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("k", F.array_join("reasons", ",").alias("reasons"), "hard_pass")


def hard_filter_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.hard_filter(listings(spark, sf_dir), SEARCH, AS_OF).select("k", "price_pcm", "bedrooms")


def layout_or_of_ands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.hard_filter(listings(spark, sf_dir), LAYOUTS, AS_OF).select("k", "bedrooms", "property_type")


def fail_reason_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.top_failures(_audited(spark, sf_dir))


def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.near_misses(_audited(spark, sf_dir)).select("k", F.get("reasons", F.lit(0)).alias("reason"))


def single_miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.single_misses(_audited(spark, sf_dir))


def budget_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.budget_sensitivity(listings(spark, sf_dir), 1200.0, F.col("bedrooms") == 2)


def layout_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.layout_sensitivity(listings(spark, sf_dir), 1500.0, 2, "k")


def result_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.insight(filters.hard_filter(listings(spark, sf_dir), SEARCH, AS_OF), 1500.0)


def area_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    out = sensitivity.compare_areas(joined, "n_name", "c_acctbal")
    return out.select("n_name", "n", *(F.round(c, 6).alias(c) for c in ("least", "median", "most")))


def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geo import box_around, in_box

    return listings(spark, sf_dir).filter(in_box(F.col("latitude"), F.col("longitude"), box_around(*CENTRE))).select("k")


def circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_circle(listings(spark, sf_dir), *CENTRE, keep_unplaced=True).select("k")


def region_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = matching.regions_of_district(listings(spark, sf_dir), regions(spark))
    return hits.select("listing_id", F.array_join("regions", "|").alias("regions"))


def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = matching.nearest_region(listings(spark, sf_dir), [(n, la, lo) for _, n, la, lo, _ in REGIONS], limit_km=4.0)
    return near.filter("region is not null").select("k", "region", F.round("km", 6).alias("km"))


def location_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    df = listings(spark, sf_dir)
    hits = matching.regions_of_district(df, regions(spark))
    names = F.transform(text.jsonish_items(F.col("stations")), lambda s: F.regexp_replace(s, r" \([0-9.]+ miles\)$", ""))
    df = df.join(hits, "listing_id", "left")
    tokens = matching.location_tokens(F.col("postcode"), F.col("postcode_district"), F.col("regions"), names)
    found = filters.location_filter(df.withColumns(tokens), ["se15"], ["old_street_station"], ["hampstead_london"], ["oval"])
    return found.select("k", F.array_join("tokens", "|").alias("tokens"))


def geo_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No listing has the token; those near the place among the 500 dearest are taken."""
    df = listings(spark, sf_dir)
    tokens = matching.location_tokens(F.col("postcode"), F.col("postcode_district"), F.array(), F.array())
    found = filters.location_filter(df.withColumns(tokens), [], [], [], ["vauxhall"])
    return filters.or_around(found.select("k", "latitude", "longitude"), df, 51.505, -0.115, F.coalesce("price_pcm", F.lit(0.0)), 500, "k").select("k")


def district_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_districts(listings(spark, sf_dir), ["se1", "N1 "]).select("k", "postcode_district")


def regions_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = matching.regions_within(listings(spark, sf_dir), [(n, la, lo) for _, n, la, lo, _ in REGIONS], 5.0)
    return near.filter(F.size("near_regions") > 0).select("k", F.array_join("near_regions", "|").alias("regions"), "primary_region")


def commute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys are known from the places of one portal's listings only; four digits, as the view has, so that no rounding is a tie."""
    df = listings(spark, sf_dir)
    times = df.filter("portal = 0").select("latitude", "longitude", (F.lit(10) + F.col("k") % 53).cast("int").alias("minutes"))
    return matching.with_commute(df, times, digits=4).select("k", "commute_minutes")


_FURNISH = """case when furnish_type is null then '' when lower(furnish_type) like '%furnished or unfurnished%' then 'flexible'
  when lower(furnish_type) = 'ask agent' then 'ask agent' when lower(furnish_type) like '%unfurn%' then 'unfurnished'
  when lower(furnish_type) like 'part%' then 'part-furnished' else 'furnished' end"""
_AVAILABLE = """case when lower(available_from) in ('now', 'available now') then null
  when available_from like '____-__-__' then cast(available_from as date)
  when available_from like '__/__/____' then cast(concat(substr(available_from, 7, 4), '-', substr(available_from, 4, 2), '-', substr(available_from, 1, 2)) as date) end"""
_PETS = """coalesce(pets_allowed, case
  when regexp_matches(t, '\\bno\\s*pets?\\b') or regexp_matches(t, '\\bpets?\\s*not\\s*(allowed|accepted|permitted)\\b') then false
  when regexp_matches(t, '\\bpets?\\s*(allowed|considered|friendly|welcome|accepted)\\b') or regexp_matches(t, '\\bpet[- ]?friendly\\b') then true end)"""
_GARDEN = "coalesce(garden, case when regexp_matches(t, '\\bno\\s+garden\\b') then false when regexp_matches(t, '\\bgarden\\b') then true end)"

WITH_AUDIT = (
    WITH_LISTING
    + f""", home as (
  select *, lower(concat_ws(' ', features, description)) as t from listing
  where not regexp_matches(lower(coalesce(property_type, '')), 'parking|garage|land|commercial|office|storage')
), checked as (
  select *,
    coalesce(price_pcm > 2200, false) as f1,
    coalesce(({_AVAILABLE}) > date '2024-02-15', false) as f2,
    ({_FURNISH}) not in ('', 'ask agent', 'flexible', 'furnished') as f3,
    replace(lower(coalesce(let_type, '')), '-', ' ') not in ('', 'long term') as f4,
    coalesce(try_cast(regexp_extract(coalesce(min_tenancy, ''), '([0-9]+(\\.[0-9]+)?)', 1) as double) > 12, false) as f5,
    coalesce(coalesce(try_cast(size_sqm as double), try_cast(replace(size_sqft, ' sq ft', '') as double) * 0.092903) < 45, false) as f6,
    coalesce(({_PETS}) <> true, false) as f7,
    coalesce(({_GARDEN}) <> true, false) as f8
  from home
), audited as (
  select *, concat_ws(',', case when f1 then 'price' end, case when f2 then 'available_from' end, case when f3 then 'furnish_type' end,
    case when f4 then 'let_type' end, case when f5 then 'min_tenancy' end, case when f6 then 'size_sqm' end,
    case when f7 then 'bool_pets_allowed' end, case when f8 then 'bool_garden' end) as reasons
  from checked
)"""
)

_KM = "2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(1 - ({a}), 0.0)))"


def km(lat: str, lng: str) -> str:
    a = f"(power(sin(radians({lat} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({lat})) * power(sin(radians({lng} - longitude) / 2), 2))"
    return _KM.format(a=a)


QUERIES = {
    f.__name__: f
    for f in (
        hard_filter_audit,
        hard_filter_pass,
        layout_or_of_ands,
        fail_reason_topn,
        near_miss,
        single_miss_counts,
        budget_sensitivity,
        layout_sensitivity,
        result_insight,
        area_compare,
        bbox,
        circle,
        region_tokens,
        nearest_region,
        location_prefilter,
        geo_fallback,
        district_filter,
        regions_within,
        commute_join,
    )
}
_BOX = "latitude between 51.505 - 6.0 / 111.32 and 51.505 + 6.0 / 111.32 and longitude between -0.115 - 6.0 / (111.32 * cos(radians(51.505))) and -0.115 + 6.0 / (111.32 * cos(radians(51.505)))"
_REGION_ROWS = ", ".join(f"({o}, '{n}', cast({la} as double), cast({lo} as double), [{', '.join(repr(p) for p in pc)}])" for o, n, la, lo, pc in REGIONS)
ORACLES = {
    "hard_filter_audit": WITH_AUDIT + " select k, reasons, reasons = '' as hard_pass from audited",
    "hard_filter_pass": WITH_AUDIT + " select k, price_pcm, bedrooms from audited where reasons = ''",
    "layout_or_of_ands": WITH_LISTING
    + """, home as (select *, case when lower(property_type) = 'ask agent' then '' else lower(coalesce(property_type, '')) end as kind from listing)
select k, bedrooms, property_type from home
where kind not like '%parking%' and (
  (coalesce(bedrooms = 2, true) and coalesce(bathrooms = 2, true) and coalesce(price_pcm <= 2600, true))
  or (coalesce(bedrooms = 1, true) and kind in ('', 'flat') and coalesce(price_pcm <= 1500, true))
  or ((kind = 'studio' or (kind in ('flat', 'apartment') and coalesce(bedrooms = 0, false))) and coalesce(price_pcm <= 1800, true)))""",
    "fail_reason_topn": WITH_AUDIT + " select split_part(reasons, ',', 1) as reason, count(*) as n from audited where reasons <> '' group by 1 order by n desc, reason limit 3",
    "near_miss": WITH_AUDIT + " select k, reasons as reason from audited where reasons <> '' and not contains(reasons, ',')",
    "single_miss_counts": WITH_AUDIT + " select reasons as reason, count(*) as n from audited where reasons <> '' and not contains(reasons, ',') group by 1",
    "budget_sensitivity": WITH_LISTING
    + """, g as (select count(*) filter (where price_pcm > 1200 and price_pcm <= 1380) as gain_115,
  count(*) filter (where price_pcm > 1200 and price_pcm <= 1500) as gain_125, count(*) filter (where price_pcm > 1200 and price_pcm <= 1800) as gain_150
  from listing where bedrooms = 2)
select *, cast(case when gain_115 > 0 then 1.15 when gain_125 > 0 then 1.25 when gain_150 > 0 then 1.5 end as double) as first_step from g""",
    "layout_sensitivity": WITH_LISTING + " select bedrooms, n from (select bedrooms, count(*) as n, min(k) as first from listing where price_pcm <= 1500 and bedrooms <> 2 group by 1) order by n desc, first limit 2",
    "result_insight": WITH_AUDIT + " select count(*) as n, min(price_pcm) as least, max(price_pcm) as most, count(*) filter (where price_pcm <= 1500) as within from audited where reasons = ''",
    "area_compare": "select n_name, count(c_acctbal) as n, round(min(c_acctbal), 6) as least, round(median(c_acctbal), 6) as median, round(max(c_acctbal), 6) as most from customer join nation on c_nationkey = n_nationkey group by 1",
    "bbox": WITH_LISTING + f" select k from listing where {_BOX}",
    "circle": WITH_LISTING + f" select k from listing where {km('51.505', '-0.115')} <= 6.0",
    "region_tokens": WITH_LISTING
    + f""", r as (select * from (values {_REGION_ROWS}) as v(ord, name, lat, lng, pcs))
select listing_id, string_agg(name, '|' order by ord) as regions from listing join r on list_contains(pcs, postcode_district) group by 1""",
    "nearest_region": WITH_LISTING
    + f""", r as (select * from (values {_REGION_ROWS}) as v(ord, name, lat, lng, pcs)),
d as (select k, name, {km('lat', 'lng')} as km from listing cross join r)
select k, min_by(name, km) as region, round(min(km), 6) as km from d group by k having min(km) <= 4.0""",
    "geo_fallback": WITH_LISTING
    + f""", best as (select * from listing order by coalesce(price_pcm, 0) desc, k limit 500)
select k from best where {km('51.505', '-0.115')} <= 3.0""",
    "district_filter": WITH_LISTING + " select k, postcode_district from listing where postcode_district in ('SE1', 'N1')",
    "regions_within": WITH_LISTING
    + f""", r as (select * from (values {_REGION_ROWS}) as v(ord, name, lat, lng, pcs)),
d as (select k, name, {km('lat', 'lng')} as km from listing cross join r)
select k, string_agg(name, '|' order by km, name) filter (where km <= 5.0) as regions, case when min(km) <= 2.0 then min_by(name, km) end as primary_region
from d group by k having min(km) <= 5.0""",
    "commute_join": WITH_LISTING
    + """, t as (select round(latitude, 4) as la, round(longitude, 4) as lo, min(cast(10 + k % 53 as int)) as commute_minutes from listing where portal = 0 group by 1, 2)
select k, commute_minutes from listing left join t on round(latitude, 4) = la and round(longitude, 4) = lo""",
}
