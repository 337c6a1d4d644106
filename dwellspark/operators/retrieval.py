"""Text and vector retrieval: BM25, cosine, and their blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors


def bm25(docs: DataFrame, terms: Sequence[str], *, key: str, body: str, corpus: list[str] | None = None) -> DataFrame:
    """key and score of documents that hold a term.

    ``corpus`` names columns whose groups are corpora of their own (default: one corpus).
    Only the query's terms are exploded; lengths and frequencies are aggregates.
    """
    by = corpus or []
    tokens = docs.select(*by, key, text.words(F.col(body)).alias("t")).withColumn("dl", F.size("t"))
    per_corpus = tokens.groupBy(*by).agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    wanted = F.array(*map(F.lit, terms))
    hits = tokens.select(*by, key, "dl", F.explode(F.filter("t", lambda x: F.array_contains(wanted, x))).alias("term")).groupBy(*by, key, "dl", "term").agg(F.count("*").alias("tf"))
    df_ = hits.groupBy(*by, "term").agg(F.count("*").alias("df"))
    join = (lambda a, b, on: a.join(b, on)) if by else (lambda a, b, on: a.crossJoin(F.broadcast(b)) if not on else a.join(b, on))  # one row of totals
    joined = join(join(hits, df_, [*by, "term"]), per_corpus, by)
    idf = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (fixed.BM25_K1 + 1) / (F.col("tf") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy(*by, key).agg(F.sum(idf * weight).alias("score"))


def vector_top(df: DataFrame, query: Sequence[float], n: int, *, key: str, vector: str) -> DataFrame:
    """The n rows nearest to a query by cosine, exactly."""
    v = F.col(vector)
    cosine = vectors.dot(v, vectors.literal(query)) / (F.sqrt(vectors.dot(v, v)) * F.lit(max(sum(x * x for x in query) ** 0.5, 1e-12)))
    return df.select(key, cosine.alias("score")).orderBy(F.desc("score"), key).limit(n)


def hybrid(lexical: DataFrame, semantic: DataFrame, n: int, *, key: str) -> DataFrame:
    """The larger of BM25 (relative to its best) and cosine, n best."""
    best = lexical.agg(F.max("score").alias("best"))
    lex = lexical.crossJoin(F.broadcast(best)).select(key, F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("lex"))  # one row
    both = lex.join(semantic.select(key, vectors.clipped_cosine(F.col("score")).alias("sem")), key, "full_outer")
    return both.select(key, F.greatest(F.coalesce("lex", F.lit(0.0)), F.coalesce("sem", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), key).limit(n)


def intent_scores(candidates: DataFrame, sims: Column, *, key: str, k: int = fixed.INTENT_TOP_K) -> DataFrame:
    """Weighted mean of each (listing, intent)'s k best texts; candidates: key, intent, field, ord."""
    weight = F.coalesce(*(F.when(F.col("field") == f, w) for f, w in fixed.FIELD_WEIGHTS.items()), F.lit(0.5))
    scored = candidates.withColumns({"sim": sims, "weight": weight})
    order = Window.partitionBy(key, "intent").orderBy(F.desc(F.col("sim") * F.col("weight")), "ord")
    best = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return best.groupBy(key, "intent").agg((F.sum(F.col("sim") * F.col("weight")) / F.sum("weight")).alias("score"))


def labelled(score: Column, sure: float = 0.75, maybe: float = 0.60) -> Column:
    return F.when(score >= sure, "confirmed").when(score >= maybe, "uncertain").otherwise("absent")


def term_counts(df: DataFrame, terms: Sequence[str], *, key: str, body: str) -> DataFrame:
    """How many of the terms each text holds."""
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    total = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    return df.select(key, total.cast("int").alias("hits"))
