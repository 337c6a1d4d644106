"""Queries of evidence, structured lookup, filtered searches of many queries, stage counts and kept tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import answers, filters, keeping
from ..session import kept_path
from .listing import WITH_LISTING, listings
from .search import AS_OF, SEARCH, WITH_AUDIT

TERMS = {"school": ("the", "thing"), "transit": (), "amenity": ("ander", "of")}
FIELDS = ("schools", "features", "notes", "stations")
#: The rows that the last stage leaves.
STAGE_LIMIT = 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a listing, its turns are chunks of fields by turn; a cosine stands in by the text's length."""
    turns = _table(spark, sf_dir, "conversations").filter("turn is not null")
    field = F.get(F.array(*map(F.lit, FIELDS)), (F.col("turn") % 4).cast("int"))
    cosine = lambda n: (F.length("text") * n) % 100 / 200.0
    sims = F.create_map(*(x for i, c in enumerate(("school", "amenity", "general")) for x in (F.lit(c), cosine(i + 1))))
    few = F.col("conv_id") % 3 == 0  # of these only a turn of a field that no category looks at, and stations
    chunks = turns.select("conv_id", F.when(few, F.when(field == "notes", field).otherwise("stations")).otherwise(field).alias("field"), F.col("turn").alias("place"), "text", sims.alias("sims"))
    return answers.evidence(chunks, TERMS, key="conv_id").select("conv_id", "category", "rank", "place", F.round("score", 4).alias("score"))


def structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening words of a turn are its terms; its record is the listing of the conversation's number."""
    said = _table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    own = F.slice(F.split("text", r"[ \t\n]+"), 1, 4)
    extra = F.get(F.array(*map(F.lit, ("prices", "bed", "let type", "EPC ratings", "station", "of"))), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    questions = said.select(F.concat_ws(":", "conv_id", "turn").alias("question"), F.col("conv_id").alias("k"), F.concat(own, F.array(extra)).alias("terms"))
    df = listings(spark, sf_dir)
    records = df.select("k", "price_pcm", F.struct("bedrooms", "bathrooms").alias("rooms"), "let_type", "epc_rating", "stations", "description", F.split("features", ", ").alias("points"))
    return answers.structured_lookup(questions, records, key="k")


def filtered_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of queries, each with its own tokens; every fourth takes all vectors."""
    df = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = df.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.array(F.concat(F.lit("l"), F.col("vec_id") % 7), F.concat(F.lit("m"), F.col("vec_id") % 5)).alias("tokens"))
    n = F.expr("vec_id div 20")
    tokens = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("l"), n % 7), F.concat(F.lit("m"), n % 9)))
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), tokens.alias("tokens"))
    return answers.filtered_vector_top(queries, rows, 5).select("query", "rank", "key", F.round("score", 6).alias("score"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of districts, then those that pass the hard filters, then the cheapest of them: counted while they are read once."""
    stages = keeping.Stages()
    near = stages.count(filters.in_districts(listings(spark, sf_dir), ["SE1", "N1", "E2", "NW3"]), "retrieved")
    passed = stages.count(filters.hard_filter(near, SEARCH, AS_OF), "passed")
    stages.count(passed.orderBy("price_pcm", "k").limit(STAGE_LIMIT), "ranked").select("k").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(stages.counts().items()), "stage string, n long")


def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written in chunks, half of them in a first run."""
    path = kept_path(spark, "chunks")
    df = listings(spark, sf_dir).select("k", "listing_id", "price_pcm")
    keeping.write_chunks(df.filter("k div 20 % 2 = 0"), path, F.expr("k div 20"))
    keeping.write_chunks(df, path, F.expr("k div 20"))
    return keeping.read_chunks(spark, path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("rows"), F.sum("k").alias("keys"))


def letters(said: Column) -> Column:
    """A small embedding of a text: how often each of eight letters stands in it, at length one."""
    counts = F.array(*(F.length("said") - F.length(F.replace(F.col("said"), F.lit(x))) for x in "aeionrst"))
    return F.transform(counts, lambda x: x / F.greatest(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12)))


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings' descriptions by their vectors, each text computed once."""
    df = listings(spark, sf_dir).select("k", F.lower("description").alias("text"))
    out, _ = keeping.embedded_once(df, kept_path(spark, "store"), letters)
    return out.select("k", *(F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in (0, 3, 7)))


QUERIES = {f.__name__: f for f in (evidence_topk, structured_lookup, filtered_vector_topk, stage_counts, chunk_manifest, embedded_texts)}

_STAGE = "lower(postcode_district) in ('se1', 'n1', 'e2', 'nw3')"


def _evidence_sql() -> str:
    parts = []
    for i, (category, words) in enumerate([*((c, t) for c, t in TERMS.items() if t), ("general", [w for t in TERMS.values() for w in t])]):
        sim = {"school": 1, "amenity": 2, "general": 3}[category]
        fields = ", ".join(f"'{f}'" for f in X.CATEGORY_FIELDS[category])
        listed = ", ".join(f"'{w}'" for w in words)
        parts.append(f"""c{i} as (select * from chunks where field in ({fields})),
            d{i} as (select conv_id, place, text, regexp_extract_all(lower(text), '[a-z0-9]+') as t from c{i}),
            n{i} as (select conv_id, count(*) as n, avg(len(t)) as avgdl from d{i} group by 1),
            f{i} as (select conv_id, place, len(t) as dl, term, count(*) as tf from (select *, unnest(t) as term from d{i}) where term in ({listed}) group by all),
            g{i} as (select conv_id, term, count(*) as df from f{i} group by all),
            b{i} as (select conv_id, place, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as b from f{i} join g{i} using (conv_id, term) join n{i} using (conv_id) group by all),
            s{i} as (select c.conv_id, c.place, c.text, coalesce(b, 0.0) as b, max(coalesce(b, 0.0)) over (partition by c.conv_id) as best, (length(c.text) * {sim}) % 100 / 200.0 as sim from c{i} c left join b{i} using (conv_id, place)),
            u{i} as (select *, round_even(greatest(b / (case when best > 0 then best else 1.0 end + 1e-8), sim), 4) as score, row_number() over (partition by conv_id, text order by place) as copy from s{i}),
            r{i} as (select conv_id, '{category}' as category, row_number() over (partition by conv_id order by score desc, place) as rank, place, score from u{i} where copy = 1)""")
    both = " union all ".join(f"select * from r{i} where rank <= {X.EVIDENCE_TOP}" for i in range(len(parts)))
    return f"""with t as (select conv_id, turn as place, text, ['schools', 'features', 'notes', 'stations'][turn % 4 + 1] as f from conversations),
        chunks as (select conv_id, place, text, case when conv_id % 3 = 0 and f <> 'notes' then 'stations' else f end as field from t), {", ".join(parts)},
        z as (select *, max(case when category <> 'general' then 1 else 0 end) over (partition by conv_id) as has from ({both}))
        select conv_id, category, cast(rank as int) as rank, place, round(score, 4) as score from z where category <> 'general' or has = 0"""


def _singular(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g'), '^(...+)s$', '\\1')"


_STATIONS = """case stations when '[{"name": "Old Street", "miles": 0.3}, {"name": "Angel Station", "miles": 0.7}]' then ['Old Street (0.3 miles)', 'Angel Station (0.7 miles)']
    when '[{"name": "Bank"}]' then ['Bank'] when 'Oval | Kennington' then ['Oval', 'Kennington'] when '[]' then cast([] as varchar[]) else [stations] end"""
ORACLES = {
    "evidence_topk": _evidence_sql(),
    "structured_lookup": WITH_LISTING
    + f""", f as (
        select k, 'price_pcm' as field, [concat(cast(cast(price_pcm as bigint) as varchar), '.0')] as items from listing where price_pcm is not null union all
        select k, 'rooms_bedrooms', [cast(bedrooms as varchar)] from listing where bedrooms is not null union all
        select k, 'rooms_bathrooms', [concat(cast(cast(bathrooms as bigint) as varchar), '.0')] from listing where bathrooms is not null union all
        select k, 'let_type', [let_type] from listing where coalesce(let_type, '') <> '' union all
        select k, 'epc_rating', [epc_rating] from listing where coalesce(epc_rating, '') <> '' union all
        select k, 'stations', {_STATIONS} from listing where stations is not null and stations <> 'ask agent' union all
        select k, 'points', string_split(features, ', ') from listing where features is not null),
        q as (select concat(conv_id, ':', turn) as question, conv_id as k, unnest(list_concat(regexp_split_to_array(text, '[ \\t\\n]+')[1:4], [['prices', 'bed', 'let type', 'EPC ratings', 'station', 'of'][(conv_id + turn) % 6 + 1]])) as t from conversations),
        s as (select distinct question, k, {_singular("t")} as t from q),
        h as (select distinct question, field, items from s join f using (k) where t <> '' and (contains({_singular("field")}, t) or contains(t, {_singular("field")})))
        select question, field, unnest(items) as item from h""",
    "filtered_vector_topk": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e, [concat('l', vec_id % 7), concat('m', vec_id % 5)] as t from embeddings),
        q as (select vec_id as query, e, case when vec_id // 20 % 4 = 0 then [] else [concat('l', vec_id // 20 % 7), concat('m', vec_id // 20 % 9)] end as t from v where vec_id % 20 = 0),
        s as (select query, vec_id as key, list_dot_product(q.e, v.e) as score from q join v on len(q.t) = 0 or list_has_any(q.t, v.t)),
        r as (select *, row_number() over (partition by query order by score desc, key) as rank from s)
        select query, cast(rank as int) as rank, key, round(score, 6) as score from r where rank <= 5""",
    "stage_counts": WITH_AUDIT
    + f""", n as (select (select count(*) from listing where {_STAGE}) as near, (select count(*) from audited where {_STAGE} and reasons = '') as good)
        select 'retrieved' as stage, near as n from n union all select 'passed', good from n union all select 'ranked', least(good, {STAGE_LIMIT}) from n""",
    "chunk_manifest": WITH_LISTING + " select k // 20 as chunk, count(*) as rows, cast(sum(k) as bigint) as keys from listing group by 1",
    "embedded_texts": WITH_LISTING
    + """, c as (select k, list_transform(['a', 'e', 'i', 'o', 'n', 'r', 's', 't'], lambda x: length(coalesce(lower(description), '')) - length(replace(coalesce(lower(description), ''), x, ''))) as c from listing),
        n as (select k, c, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-12) as n from c)
        select k, round(c[1] / n, 6) as v0, round(c[4] / n, 6) as v3, round(c[8] / n, 6) as v7 from n""",
}
