"""Queries of vector and blended retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import retrieval
from ..operators.sensitivity import ranked_within

QUERY_ID = 0


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df, list(df.filter(F.col("vec_id") == QUERY_ID).select("embedding").first()[0])  # one query


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _embeddings(spark, sf_dir)
    return retrieval.vector_top(df, q, 20, key="vec_id", vector="embedding").select("vec_id", F.round("score", 6).alias("score"))


def top2_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a listing, its vectors are the segments of a field."""
    df, q = _embeddings(spark, sf_dir)
    sims = df.select("label", V.shifted_cosine(V.dot(F.col("embedding"), V.literal(q))).alias("sim"))
    sims = ranked_within(sims, ["label"], [F.desc("sim")], 2).groupBy("label").agg(F.collect_list("sim").alias("s"))  # two a label
    return sims.select("label", F.round(V.top2(F.col("s")), 6).alias("score"))


def intent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _embeddings(spark, sf_dir)
    field = F.get(F.array(*map(F.lit, ("schools", "stations", "features", "description"))), (F.col("vec_id") % 4).cast("int"))
    texts = df.select(F.col("label").alias("listing"), F.lit("quiet").alias("intent"), field.alias("field"), F.col("vec_id").alias("ord"), "embedding")
    out = retrieval.intent_scores(texts, V.shifted_cosine(V.dot(F.col("embedding"), V.literal(q))), key="listing")
    return out.select("listing", "intent", F.round("score", 6).alias("score"))


def vector_lookup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _embeddings(spark, sf_dir)
    return df.select("vec_id", retrieval.labelled(V.clipped_cosine(V.dot(F.col("embedding"), V.literal(q))), sure=0.45, maybe=0.3).alias("verdict"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by words, and by the vector of the same number."""
    df, q = _embeddings(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexical = retrieval.bm25(docs, ("thing", "the"), key="doc_id", body="text")
    semantic = df.select(F.col("vec_id").alias("doc_id"), V.dot(F.col("embedding"), V.literal(q)).alias("score"))
    return retrieval.hybrid(lexical, semantic, 20, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


def best_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _embeddings(spark, sf_dir)
    scored = df.select("label", "vec_id", F.round(V.dot(F.col("embedding"), V.literal(q)), 6).alias("score"))
    return ranked_within(scored, ["label"], [F.desc("score"), F.asc("vec_id")], 3).select("label", "place", "vec_id", "score")


QUERIES = {f.__name__: f for f in (vector_topk, top2_field_score, intent_score, vector_lookup_labels, hybrid_topk, best_of_label)}

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"
_Q = f"with q as (select embedding as q from embeddings where vec_id = {QUERY_ID}), d as (select e.*, {_DOT.format('e.embedding', 'q.q')} as dot, {_DOT.format('e.embedding', 'e.embedding')} as n2, {_DOT.format('q.q', 'q.q')} as q2 from embeddings e, q)"
ORACLES = {
    "vector_topk": _Q + " select vec_id, round(dot / (sqrt(n2) * greatest(sqrt(q2), 1e-12)), 6) as score from d order by dot / (sqrt(n2) * sqrt(q2)) desc, vec_id limit 20",
    "top2_field_score": _Q + ", r as (select label, least(greatest((dot + 1) / 2, 0), 1) as s, row_number() over (partition by label order by dot desc) as n from d) select label, round(0.7 * max(s) + 0.3 * coalesce(max(case when n = 2 then s end), max(s)), 6) as score from r group by label",
    "intent_score": _Q
    + """, s as (select label as listing, vec_id, least(greatest((dot + 1) / 2, 0), 1) as sim, cast(case vec_id % 4 when 0 then 1.0 when 1 then 1.0 when 2 then 0.8 else 0.6 end as double) as w from d),
r as (select *, row_number() over (partition by listing order by sim * w desc, vec_id) as n from s)
select listing, 'quiet' as intent, round(sum(sim * w) / sum(w), 6) as score from r where n <= 4 group by 1""",
    "vector_lookup_labels": _Q + " select vec_id, case when least(greatest(dot, 0), 1) >= 0.45 then 'confirmed' when least(greatest(dot, 0), 1) >= 0.3 then 'uncertain' else 'absent' end as verdict from d",
    "best_of_label": _Q + ", r as (select label, vec_id, round(dot, 6) as score, row_number() over (partition by label order by round(dot, 6) desc, vec_id) as place from d) select label, cast(place as int) as place, vec_id, score from r where place <= 3",
    "hybrid_topk": _Q
    + """, tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents), len as (select doc_id, count(*) as dl from tok group by 1),
tot as (select count(*) as n, avg(coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0)) as avgdl from documents),
tf as (select doc_id, term, count(*) as tf from tok where term in ('thing', 'the') group by 1, 2), df as (select term, count(*) as df from tf group by 1),
lex as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from tf join len using (doc_id) join df using (term) cross join tot group by 1),
b as (select coalesce(lex.doc_id, d.vec_id) as doc_id, greatest(coalesce(s / (select max(s) from lex), 0), coalesce(least(greatest(dot, 0), 1), 0)) as score from lex full join d on lex.doc_id = d.vec_id)
select doc_id, round(score, 6) as score from b order by b.score desc, doc_id limit 20""",
}
