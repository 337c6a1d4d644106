"""Preference scores from a side table of vectors: a listing's segments by field, found under its URL or else its id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors


def lookup_key(url: Column, listing_id: Column) -> Column:
    """What a listing is looked up by: its URL, or where it has none its id; null if it has neither."""
    prefixed = lambda kind, c: F.when(text.safe_text(c) != "", F.concat(F.lit(f"{kind}::"), text.safe_text(c)))
    return F.coalesce(prefixed("url", url), prefixed("listing_id", listing_id))


def by_key(records: DataFrame) -> DataFrame:
    """key, record: each record under its URL and under its id; of records under one key the last counts (``record`` orders them)."""
    none = F.lit(None).cast("string")
    keys = F.array_compact(F.array(lookup_key(F.col("url"), none), lookup_key(none, F.col("listing_id"))))
    each = records.select("record", F.explode(keys).alias("key"))
    return each.groupBy("key").agg(F.max("record").alias("record"))


def preference_scores(listings: DataFrame, records: DataFrame, segments: DataFrame, intents: Mapping[str, Sequence[float]], *, key: str = "listing_id", weights: Mapping[str, float] = fixed.SEGMENT_WEIGHTS) -> DataFrame:
    """key, preference_score, hits, evidence: for each listing that has segments.

    ``records``: record, url, listing_id; ``segments``: record, field, place, vector.  A field's
    score for an intent is 0.7 of its nearest segment and 0.3 of the next (similarities within
    0 and 1); an intent's is the mean of the fields that there are, by their weights; a listing's
    is the mean of all intents'.  Hits are the intents from ``INTENT_HIT`` on, in their order;
    evidence has the two nearest segments of each field for every hit.  Listings without segments
    have no row, so that the caller can fall back to their texts.
    """
    if not intents:
        return listings.select(key, F.lit(0.0).alias("preference_score"), F.array().cast("array<string>").alias("hits"), F.array().cast("array<struct<intent:string,field:string,place:int,sim:double>>").alias("evidence"))
    found = listings.select(key, lookup_key(F.col("url"), F.col("listing_id")).alias("key")).filter("key is not null").join(by_key(records), "key").select(key, "record")
    # the intents of a search are a few literals of the plan, so a segment is compared to all of them where it lies
    asked = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("intent"), vectors.shifted_cosine(vectors.dot(F.col("vector"), vectors.literal(v))).alias("sim")) for i, (name, v) in enumerate(intents.items())))
    near = segments.filter(F.col("field").isin(*weights)).select("record", "field", F.col("place").cast("int").alias("place"), F.explode(asked).alias("a")).select("record", "field", "place", "a.*")
    best = near.groupBy("record", "ord", "intent", "field").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "place"))), 1, 2).alias("two"))
    weight = F.coalesce(*(F.when(F.col("field") == f, w) for f, w in weights.items()))
    score = vectors.top2(F.transform("two", lambda x: -x["far"]))
    of_field = best.select("record", "ord", "intent", "field", weight.alias("w"), score.alias("s"), F.transform("two", lambda x: F.struct(F.col("intent"), F.col("field"), x["place"].alias("place"), (-x["far"]).alias("sim"))).alias("two"))
    of_intent = of_field.groupBy("record", "ord", "intent").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("s"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("field", "two"))), lambda x: x["two"])).alias("near"))
    hit = F.col("s") >= fixed.INTENT_HIT
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("ord", value.alias("v"))))), lambda x: x["v"])
    of_record = of_intent.groupBy("record").agg(F.avg("s").alias("preference_score"), in_order(F.col("intent")).alias("hits"), F.flatten(in_order(F.col("near"))).alias("evidence"))
    return found.join(of_record, "record").select(key, "preference_score", "hits", "evidence")


def with_preference(listings: DataFrame, scores: DataFrame, otherwise: Column, *, key: str = "listing_id") -> DataFrame:
    """``listings`` with ``preference_score`` and ``hits``, the score ``otherwise`` where the side table has nothing."""
    met = listings.join(scores.select(key, F.col("preference_score").alias("_found"), "hits"), key, "left")
    return met.withColumn("preference_score", F.coalesce("_found", otherwise)).drop("_found")
