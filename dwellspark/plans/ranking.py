"""Queries of ranking, pages and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..operators import preference as P
from ..operators import ranking as R
from .listing import WITH_LISTING, listings
from .search import AS_OF, SEARCH, WITH_AUDIT

UNKNOWN = SEARCH


def soft_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hard filters, then the weighted score's twenty best."""
    ranked = R.rank(filters.hard_filter(listings(spark, sf_dir), SEARCH, AS_OF), SEARCH, AS_OF)
    return R.top(ranked, 20).select("rank", "listing_id", F.round("final_score", 6).alias("final_score"), "match_pct")


def _side_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, list[float]]]:
    """Vectors in fours are a listing's segments; every third record has a URL, the others ids alone. Two vectors are intents."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    record = F.expr("vec_id div 4")
    records = df.select(record.alias("record")).distinct().select("record", F.when(F.col("record") % 3 == 0, F.concat(F.lit("u/"), "record")).alias("url"), F.concat(F.lit("part:"), "record").alias("listing_id"))
    segments = df.select(record.alias("record"), F.when(F.col("vec_id") % 4 < 3, "features").otherwise("description").alias("field"), (F.col("vec_id") % 4).alias("place"), F.col("embedding").alias("vector"))
    asked = df.filter("vec_id in (5, 21)").orderBy("vec_id").collect()  # two rows
    return records, segments, {f"intent {r['vec_id']}": list(r["embedding"]) for r in asked}


def preference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).withColumn("url", F.when(F.col("k") % 3 == 0, F.concat(F.lit("u/"), "k")))
    out = P.preference_scores(df, *_side_table(spark, sf_dir))
    return out.select("listing_id", F.round("preference_score", 6).alias("score"), F.array_join("hits", "|").alias("hits"), F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["intent"], e["field"], e["place"])), "|").alias("evidence"))


def soft_rank_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking with intents: preference scores from the side table, half a point where it has none."""
    df = listings(spark, sf_dir).withColumn("url", F.when(F.col("k") % 3 == 0, F.concat(F.lit("u/"), "k")))
    passed = filters.hard_filter(df, SEARCH, AS_OF)
    scored = P.with_preference(passed, P.preference_scores(passed, *_side_table(spark, sf_dir)), F.lit(0.5))
    return R.top(R.rank(scored, SEARCH, AS_OF), 20).select("rank", "listing_id", F.round("final_score", 6).alias("final_score"), F.round("preference_score", 6).alias("preference"), F.coalesce(F.array_join("hits", "|"), F.lit("")).alias("hits"))


def unknown_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("k", F.round(R.unknown_penalty(UNKNOWN, AS_OF), 6).alias("penalty"))


def match_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir)
    return df.select("k", R.match_pct(SEARCH, df.columns, F.lit(0.0), F.lit(0.0)).alias("match_pct"))


def deposit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("k", F.round(R.deposit_score(F.col("deposit"), F.col("price_pcm")), 6).alias("score"))


def freshness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("k", F.round(R.freshness_score(F.col("added_date"), AS_OF), 6).alias("score"))


def headroom_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("k", F.round(R.headroom_score(F.col("price_pcm"), 1500.0), 6).alias("score"))


def page_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return R.page(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 25).select("place", "o_orderkey", "has_more")


def commute_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("k") % 5 == 0, None).otherwise(F.col("k") % 70).cast("int")
    return listings(spark, sf_dir).select("k", R.commute_adjusted(F.lit(90), minutes).alias("match_pct"))


QUERIES = {f.__name__: f for f in (soft_rank_topk, preference_scores, soft_rank_intents, unknown_penalty, match_pct, deposit_score, freshness_score, headroom_score, page_n, commute_adjusted)}

_AMOUNT = """case when lower(trim(coalesce(deposit, ''))) in ('', 'ask agent') then null
  else try_cast(regexp_extract(replace(deposit, ',', ''), '([0-9]+(\\.[0-9]+)?)', 1) as double) end"""
_DEPOSIT = f"coalesce(case when price_pcm > 0 then exp(-(({_AMOUNT}) / price_pcm) / 2) else exp(-({_AMOUNT}) / 3000) end, 0.4)"
_AGE = """case lower(added_date) when 'added today' then 0 when 'yesterday' then 1 when '2024-01-05' then 10 when 'reduced on 05/01/2024' then 10 when '28/12/2023' then 18 end"""
_FRESH = f"coalesce(exp(-ln(2) / 14 * ({_AGE})), 0.4)"
_PENALTY = """least(0.6, case when price_pcm is null then 0.2 else 0 end
  + case when available_from is null or lower(available_from) in ('ask agent', 'someday') then 0.14 else 0 end
  + case when furnish_type is null or lower(furnish_type) = 'ask agent' then 0.08 else 0 end
  + case when coalesce(let_type, '') = '' then 0.1 else 0 end
  + case when not regexp_matches(coalesce(min_tenancy, ''), '[0-9]') then 0.08 else 0 end
  + case when size_sqm is null and size_sqft is null then 0.1 else 0 end)"""
_PETS = """coalesce(pets_allowed, case
  when regexp_matches(t, '\\bno\\s*pets?\\b') or regexp_matches(t, '\\bpets?\\s*not\\s*(allowed|accepted|permitted)\\b') then false
  when regexp_matches(t, '\\bpets?\\s*(allowed|considered|friendly|welcome|accepted)\\b') or regexp_matches(t, '\\bpet[- ]?friendly\\b') then true end)"""
_GARDEN = "coalesce(garden, case when regexp_matches(t, '\\bno\\s+garden\\b') then false when regexp_matches(t, '\\bgarden\\b') then true end)"
_FURNISHED = "case when lower(furnish_type) = 'furnished' then 8.0 else 0.0 end"
_HALF = "case when ({0}) is null then 6.25 when ({0}) then 12.5 else 0 end"
_PCT = f"cast(greatest(50, least(100, round_even(100 * ({_HALF.format(_PETS)} + {_HALF.format(_GARDEN)} + {_FURNISHED}) / 33.0, 0))) as int)"
_BOTH = f"((case when coalesce({_PETS}, false) then 1.0 else 0.0 end + case when coalesce({_GARDEN}, false) then 1.0 else 0.0 end) / 2)"

_PREFERENCE = """e as (select vec_id // 4 as rec, vec_id % 4 as place, case when vec_id % 4 < 3 then 'features' else 'description' end as field, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
i as (select vec_id as ord, concat('intent ', vec_id) as intent, list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id in (5, 21)),
sims as (select rec, ord, intent, field, place, greatest(0.0, least(1.0, (list_dot_product(v, q) + 1) / 2)) as sim from e cross join i),
ranked_segments as (select *, row_number() over (partition by rec, ord, field order by sim desc, place) as r from sims),
of_field as (select rec, ord, intent, field, case field when 'features' then 0.8 else 0.6 end as w, 0.7 * max(sim) filter (where r = 1) + 0.3 * coalesce(max(sim) filter (where r = 2), max(sim) filter (where r = 1)) as s,
  string_agg(concat(intent, ':', field, ':', place), '|' order by r) filter (where r <= 2) as near from ranked_segments group by 1, 2, 3, 4),
of_intent as (select rec, ord, intent, cast(sum(w * s) / sum(w) as double) as s, string_agg(near, '|' order by field) as near from of_field group by 1, 2, 3),
pref as (select concat('part:', rec) as listing_id, avg(s) as score, coalesce(string_agg(intent, '|' order by ord) filter (where s >= 0.45), '') as hits, coalesce(string_agg(near, '|' order by ord) filter (where s >= 0.45), '') as evidence from of_intent group by rec)"""

ORACLES = {
    "soft_rank_topk": WITH_AUDIT
    + f""", scored as (
  select listing_id, 0.3 * 0.5 + 0.05 * {_DEPOSIT} + 0.06 * {_FRESH} + 0.1 * coalesce(greatest((2200 - price_pcm) / 2200, 0), 0)
    + 0.12 * {_BOTH} - 0.2 * {_PENALTY} as s, {_PCT} as match_pct
  from audited where reasons = ''
), ranked as (select *, row_number() over (order by round(s, 9) desc, listing_id) as rank from scored)
select cast(rank as int) as rank, listing_id, round(s, 6) as final_score, match_pct from ranked where rank <= 20""",
    "preference_scores": WITH_LISTING + f", {_PREFERENCE} select listing_id, round(score, 6) as score, hits, evidence from pref join listing using (listing_id)",
    "soft_rank_intents": WITH_AUDIT
    + f""", {_PREFERENCE}, scored as (
  select listing_id, coalesce(score, 0.5) as p, hits, 0.3 * coalesce(score, 0.5) + 0.05 * {_DEPOSIT} + 0.06 * {_FRESH} + 0.1 * coalesce(greatest((2200 - price_pcm) / 2200, 0), 0)
    + 0.12 * {_BOTH} - 0.2 * {_PENALTY} as s
  from audited left join pref using (listing_id) where reasons = ''
), ranked as (select *, row_number() over (order by round(s, 9) desc, listing_id) as rank from scored)
select cast(rank as int) as rank, listing_id, round(s, 6) as final_score, round(p, 6) as preference, coalesce(hits, '') as hits from ranked where rank <= 20""",
    "unknown_penalty": WITH_LISTING + f" select k, round(cast({_PENALTY} as double), 6) as penalty from listing",
    "match_pct": WITH_LISTING + f", x as (select *, lower(concat_ws(' ', features, description)) as t from listing) select k, {_PCT} as match_pct from x",
    "deposit_score": WITH_LISTING + f" select k, round({_DEPOSIT}, 6) as score from listing",
    "freshness_score": WITH_LISTING + f" select k, round({_FRESH}, 6) as score from listing",
    "headroom_score": WITH_LISTING + " select k, round(coalesce(greatest((1500 - price_pcm) / 1500, 0), 0), 6) as score from listing",
    "page_n": "select cast(n - 50 as int) as place, o_orderkey, total > 75 as has_more from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as n, count(*) over () as total from orders) where n between 51 and 75",
    "commute_adjusted": WITH_LISTING + " select k, cast(greatest(50, 90 - case when k % 5 = 0 then 5 when k % 70 <= 30 then 0 when k % 70 <= 45 then 7 else 15 end) as int) as match_pct from listing",
}
