"""Queries of entity resolution, merging, syncing and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import signals, text
from ..operators import matching, sync
from ..streaming.ingest import ingest_events
from .listing import WITH_LISTING, listings

PRICE_LIMIT = 600.0
CUTOFF = "2024-01-01T00:00:00"


def _portals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = listings(spark, sf_dir)
    return df.filter("portal = 0"), df.filter("portal = 1")


NEAR = {"lat": "mlat", "lng": "mlon", "price_limit": PRICE_LIMIT}


def spatial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_matches(*_portals(spark, sf_dir), **NEAR)


def spatial_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unmatched(*_portals(spark, sf_dir), **NEAR).select("listing_id")


def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _portals(spark, sf_dir)
    merged = matching.merge_records(a, b, matching.first_matches(a, b, **NEAR))
    return merged.select("listing_id", "source_site", "other_id", "pets_allowed", "garden", "bills_included", "epc_rating", "deposit", "min_tenancy", "furnish_type", "features", "description")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("listing_id"), "o_totalprice", "o_orderdate")
    return orders.filter("listing_id % 10 < 7"), orders.filter("listing_id % 10 > 2").withColumn("o_totalprice", F.col("o_totalprice") + 1)


def key_diff_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.key_diff(*_halves(spark, sf_dir))


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.incremental_sync(*_halves(spark, sf_dir)).select("listing_id", F.round("o_totalprice", 4).alias("price"))


def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.purge_stale(listings(spark, sf_dir), CUTOFF).select("k", "scraped_at")


def payload_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).select("k", "epc_rating", "deposit")
    updates = df.filter("k % 3 = 0").select("k", F.concat(F.lit("E"), (F.col("k") % 5).cast("string")).alias("epc"), F.lit("£1").alias("dep"))
    return sync.update_payload(df, updates, "k", {"deposit": "dep"}, {"epc_rating": "epc"})


def discovery_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.concat(F.lit("/u/"), F.col("event_id").cast("string")).alias("url"))
    return sync.discovery(events, "user_id", "event_id", "url", "event_type").select("user_id", "url", F.array_join("discovery_paths", ",").alias("paths"))


def paths_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the event types of the user of the same number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("c_custkey"), "event_id", "event_type", F.lit("u").alias("url"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")
    joined = sync.with_discovery(customers, sync.discovery(events, "c_custkey", "event_id", "url", "event_type"), "c_custkey")
    return joined.select("c_custkey", "c_name", F.array_join("discovery_paths", ",").alias("paths"))


def district_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    paths = sync.discovery(events.withColumn("url", F.lit("u")), "user_id", "event_id", "url", "event_type")
    return paths.select(F.explode("discovery_paths").alias("p")).groupBy(F.split("p", " ")[0].alias("district")).agg(F.count("*").alias("n"))


def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_id", text.uuid5(F.col("listing_id")).alias("point_id"))


def feature_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir)
    return df.select("k", signals.feature_bullets(df.columns).alias("bullets"))


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir)
    return df.select("k", matching.embed_text(df.columns).alias("text"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded run of the streaming ingest over ``events``: latest row of each user after retention."""
    return ingest_events(spark, sf_dir, cutoff="2024-01-10T00:00:00")


QUERIES = {
    f.__name__: f
    for f in (
        spatial_match,
        spatial_dedup,
        merge_records,
        key_diff_sync,
        incremental_sync,
        retention_purge,
        payload_update,
        discovery_paths,
        paths_attached,
        district_counts,
        uuid5_ids,
        feature_synthesis,
        embed_text,
        stream_ingest,
    )
}

_METRES = "2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(b.mlat - a.mlat) / 2), 2) + cos(radians(a.mlat)) * cos(radians(b.mlat)) * power(sin(radians(b.mlon - a.mlon) / 2), 2))))"
_PAIRS = (
    WITH_LISTING
    + f""", pairs as (
  select a.listing_id as a_key, b.listing_id as b_key from listing a join listing b on a.portal = 0 and b.portal = 1
  where coalesce(a.bedrooms = b.bedrooms, true) and coalesce(abs(a.price_pcm - b.price_pcm) <= {PRICE_LIMIT}, true) and {_METRES} <= 10.0
), matches as (select a_key, min(b_key) as b_key from pairs group by 1)"""
)
_BULLETS = """nullif(concat_ws(chr(10), case garden when true then 'Garden' when false then 'No Garden' end,
  case bills_included when true then 'Bills Included' when false then 'Bills Not Included' end,
  case pets_allowed when true then 'Pets Allowed' when false then 'No Pets Allowed' end,
  case when epc_rating <> '' then concat('EPC Rating: ', epc_rating) end), '')"""
_BLANK = "({0} is null or lower(trim({0})) in ('ask agent', '', 'none', '[]'))"


def _fill(c: str) -> str:
    return f"case when b.listing_id is not null and {_BLANK.format('a.' + c)} and not {_BLANK.format('b.' + c)} then b.{c} else a.{c} end as {c}"


ORACLES = {
    "uuid5_ids": WITH_LISTING
    + f""", h as (select listing_id, sha1(unhex('{X.UUID_NAMESPACE}') || encode(listing_id)) as h from listing)
        select listing_id, concat_ws('-', h[1:8], h[9:12], concat('5', h[14:16]), concat('89ab'[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1], h[18:20]), h[21:32]) as point_id from h""",
    "spatial_match": _PAIRS + " select a_key, b_key from matches",
    "spatial_dedup": _PAIRS + " select listing_id from listing where portal = 1 and listing_id not in (select b_key from pairs)",
    "merge_records": _PAIRS
    + f""", l as (select *, {_BULLETS} as bullets from listing)
select a.listing_id, case when b.listing_id is null then 'a' else 'a+b' end as source_site, b.listing_id as other_id,
  coalesce(b.pets_allowed, a.pets_allowed) as pets_allowed, coalesce(b.garden, a.garden) as garden, coalesce(b.bills_included, a.bills_included) as bills_included,
  coalesce(b.epc_rating, a.epc_rating) as epc_rating, {_fill('deposit')}, {_fill('min_tenancy')}, {_fill('furnish_type')},
  case when b.listing_id is null then a.features else nullif(concat_ws(chr(10), nullif(trim(a.features), ''), coalesce(b.bullets, nullif(trim(b.features), ''))), '') end as features,
  {_fill('description')}
from l a left join matches m on a.listing_id = m.a_key left join l b on b.listing_id = m.b_key where a.portal = 0
union all
select listing_id, 'b', null, pets_allowed, garden, bills_included, epc_rating, deposit, min_tenancy, furnish_type, features, description
from l where portal = 1 and listing_id not in (select b_key from matches)""",
    "key_diff_sync": "select o_orderkey as listing_id, case when o_orderkey % 10 >= 7 then 'added' when o_orderkey % 10 <= 2 then 'removed' else 'kept' end as status from orders",
    "incremental_sync": "select o_orderkey as listing_id, round(o_totalprice + case when o_orderkey % 10 >= 7 then 1 else 0 end, 4) as price from orders where o_orderkey % 10 > 2",
    "retention_purge": WITH_LISTING + f" select k, scraped_at from listing where scraped_at is null or scraped_at = '' or scraped_at >= '{CUTOFF}'",
    "payload_update": WITH_LISTING
    + " select k, coalesce(nullif(epc_rating, ''), case when k % 3 = 0 then concat('E', cast(k % 5 as varchar)) end) as epc_rating, case when k % 3 = 0 then '£1' else deposit end as deposit from listing",
    "discovery_paths": """with f as (select user_id, event_type, min(event_id) as e from events group by 1, 2)
select u.user_id, u.url, p.paths from (select user_id, concat('/u/', cast(min(event_id) as varchar)) as url from events group by 1) u
join (select user_id, string_agg(event_type, ',' order by e) as paths from f group by 1) p on u.user_id = p.user_id""",
    "paths_attached": """with f as (select user_id, event_type, min(event_id) as e from events group by 1, 2),
p as (select user_id, string_agg(event_type, ',' order by e) as paths from f group by 1)
select cast(c_custkey as bigint) as c_custkey, c_name, coalesce(paths, '') as paths from customer left join p on c_custkey = user_id""",
    "district_counts": "select event_type as district, count(distinct user_id) as n from events group by 1",
    "feature_synthesis": WITH_LISTING + f" select k, {_BULLETS} as bullets from listing",
    "embed_text": WITH_LISTING
    + """ select k, concat_ws(' ', nullif(title, ''), nullif(address, ''), substr(nullif(description, ''), 1, 300), substr(nullif(features, ''), 1, 200),
  case when coalesce(pets_allowed, false) or coalesce(garden, false) or coalesce(bills_included, false) then concat('Amenities: ',
    concat_ws(', ', case when pets_allowed then 'pets allowed' end, case when garden then 'garden' end, case when bills_included then 'bills included' end)) end,
  case when epc_rating <> '' then concat('EPC rating ', epc_rating) end) as text from listing""",
    "stream_ingest": """select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events
where ts >= timestamp '2024-01-10 00:00:00') where n = 1""",
}
