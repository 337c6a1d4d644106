"""A listing view over ``part``: the same SQL text in Spark and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(number: str, *values: str | None) -> str:
    """The SQL for the value at ``number`` modulo the number of values; VALUE_AT and LIST_OF are each engine's own functions."""
    listed = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"VALUE_AT(LIST_OF({listed}), cast((p_partkey {number}) % {len(values)} as int) + 1)"


FEATURES = (
    "Private garden, off-street parking",
    "No pets, no smoking",
    "Pet friendly flat with driveway",
    "All bills included",
    "Students welcome, no garden",
    None,
    "Bills not included",
    "Garage and rear garden",
    "DSS accepted, families welcome",
    "Non-smoking, no parking",
)
DESCRIPTIONS = (
    "A bright home close to shops. Viewing advised soon.",
    "Guarantor required for all tenants. No DSS please.",
    None,
    "Deposit protected with TDS. Pets considered by the landlord.",
    "Unfortunately we cannot allow pets here.",
    "Universal credit accepted. Ask for more.",
    "Deposit held by landlord until moving out.",
    "Sorry, no students.",
    "Quiet street; communal garden.",
    "Short",
)
DISTRICTS = ("SE1", "N1", "E2", "NW3", "SW9", "W2", "EC1", "E14", "SE15", "N16")

LISTING = f"""
select
  concat('part:', cast(p_partkey as string)) as listing_id,
  p_partkey as k,
  cast(p_partkey % 2 as int) as portal,
  case when p_partkey % 13 = 0 then null else cast(800 as double) + cast((p_partkey * 37) % 2400 as double) end as price_pcm,
  {pick("", "Flat", "Apartment", "Studio", "Terraced", "Parking space", "Detached", "ask agent", "Semi-Detached", "flat", "Maisonette", "House", None)} as property_type,
  case when p_partkey % 11 = 0 then null else cast(p_size % 5 as int) end as bedrooms,
  case when p_partkey % 7 = 0 then null else cast(1 + p_partkey % 3 as double) end as bathrooms,
  {pick("* 3 + 1", "Furnished", "Unfurnished", "Part-furnished", "Ask agent", "Furnished or unfurnished, landlord is flexible", "part_furnished", None, "furnished")} as furnish_type,
  {pick("* 7 + 2", "Long term", "Short term", "long-term", None, "")} as let_type,
  {pick("* 5 + 3", "now", "2024-03-01", "15/03/2024", "ask agent", "2024-02-10", None, "Available now", "25/12/2023", "someday")} as available_from,
  {pick("* 3 + 2", "6 months", "12 months", "ask agent", "18", None, "1.5 months")} as min_tenancy,
  case when p_partkey % 4 = 0 then cast(30 + p_partkey % 70 as string) end as size_sqm,
  case when p_partkey % 4 = 1 then concat(cast(400 + p_partkey % 900 as string), ' sq ft') end as size_sqft,
  case p_partkey % 5 when 0 then concat('£', cast(900 + (p_partkey * 13) % 1500 as string)) when 1 then null when 2 then 'Ask agent' when 3 then '£1,600 (5 weeks)' else 'none given' end as deposit,
  {pick("* 11 + 1", "2024-01-05", "Added today", "yesterday", None, "Reduced on 05/01/2024", "gibberish", "28/12/2023")} as added_date,
  {pick("* 3", *FEATURES)} as features,
  {pick("* 7 + 4", *DESCRIPTIONS)} as description,
  case p_partkey % 9 when 0 then true when 1 then false end as pets_allowed,
  case p_partkey % 8 when 0 then true when 3 then false end as garden,
  case p_partkey % 10 when 0 then true when 7 then false end as bills_included,
  case p_partkey % 6 when 0 then 'C' when 1 then 'D' when 2 then '' end as epc_rating,
  {pick("* 3 + 1", *DISTRICTS)} as postcode_district,
  concat({pick("* 3 + 1", *DISTRICTS)}, ' ', cast(p_partkey % 9 as string), 'AB') as postcode,
  concat(p_name, ' Street') as address,
  p_name as title,
  {pick("* 5", '[{"name": "Old Street", "miles": 0.3}, {"name": "Angel Station", "miles": 0.7}]', "ask agent", '[{"name": "Bank"}]', "Oval | Kennington", None, "Waterloo", "[]")} as stations,
  cast(51.30 as double) + cast((p_partkey * 7919) % 4000 as double) / 10000 as latitude,
  cast(-0.40 as double) + cast((p_partkey * 104729) % 6000 as double) / 10000 as longitude,
  cast(51.50 as double) + cast((p_partkey * 7919) % 211 as double) / 100000 as mlat,
  cast(-0.10 as double) + cast((p_partkey * 104729) % 307 as double) / 100000 as mlon,
  {pick("* 7", "2024-01-01T10:00:00", "2023-12-01T09:30:00", "", None, "2024-01-12T00:00:00")} as scraped_at
from {{part}}
"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view. Its rows are few bytes but much work each, so they aren't left in as few tasks as the file's size asks for."""
    query = LISTING.replace("VALUE_AT", "element_at").replace("LIST_OF", "array").replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")  # braces within are text
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    return spark.sql(query, part=part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey"))


#: The view as a common table expression, for the queries' SQL.
WITH_LISTING = "with listing as (" + LISTING.replace("VALUE_AT", "list_extract").replace("LIST_OF", "list_value").replace("{part}", "part") + ")"

#: A few regions: order, name, latitude, longitude, districts.
REGIONS = (
    (0, "South Bank", 51.505, -0.115, ("SE1",)),
    (1, "Islington", 51.536, -0.103, ("N1", "EC1")),
    (2, "Shoreditch", 51.526, -0.078, ("E2", "EC1", "N1")),
    (3, "Hampstead", 51.556, -0.178, ("NW3",)),
    (4, "Brixton", 51.462, -0.115, ("SW9",)),
    (5, "Paddington", 51.516, -0.176, ("W2",)),
    (6, "Canary Wharf", 51.505, -0.02, ("E14",)),
    (7, "Peckham", 51.474, -0.069, ("SE15",)),
)


def regions(spark: SparkSession) -> DataFrame:
    rows = [(o, n, la, lo, list(pc)) for o, n, la, lo, pc in REGIONS]
    return spark.createDataFrame(rows, "ord int, name string, lat double, lng double, postcodes array<string>")
