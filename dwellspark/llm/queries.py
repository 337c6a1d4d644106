"""The thin queries that apply each operator to the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import conversations, secret_tags
from .clustering import k_means, report
from .decontaminate import find_contamination
from .packing import pack_documents
from .rans import encode_corpus, read_documents
from .simhash import simhash_components
from .sharding import shard
from .topk import top_k
from .pii import SECRET_WORDS, base_spans, count_of, find_pii, listed
from .lines import drop_boilerplate
from .toxicity import score_toxicity
from .substrings import dedup_substrings

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(F.array_distinct(c["items"])).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct(c["items"])), ","), 256).alias("items_sha256"),
        c["contaminated"].alias("contaminated"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = encode_corpus(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, "vec_id % 50 = 0")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        count_of("email").alias("n_email"),
        count_of("ip").alias("n_ip"),
        count_of("card").alias("n_card"),
        count_of("phone").alias("n_phone"),
        F.sha2(listed(base_spans()), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        (F.size("pii") > 0).alias("has_pii"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = k_means(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return report(found).withColumnRenamed("id", "vec_id")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_tags.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(secret_tags.count_of(k).alias(f"n_{k}") for k in secret_tags.BASE),
        F.sha2(listed(secret_tags.base_only()), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        secret_tags.count_of("tagged").alias("n_tagged"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.report(conversations.damage(rows), rows)


QUERIES: dict[str, Query] = {
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op3_token_output": op3_token_output,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sharding": op6_sharding,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_pii": op10_pii,
    "op4_line_dedup": op4_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_secret_scan": op12_secret_scan,
    "op13_conversation_repair": op13_conversation_repair,
}
#: Text with A-Z in lower case, its words, and words between white space, in the oracles' SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PII_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(hit, '.'), lambda x: try_cast(x as double))) <= 255"),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        """length(digits) between 14 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda j:
              case when j % 2 = 1 then cast(substr(reverse(digits), j, 1) as int)
              else cast(substr(reverse(digits), j, 1) as int) * 2 % 10 + cast(substr(reverse(digits), j, 1) as int) * 2 // 10 end)) % 10 = 0""",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 10 and 15"),
    (
        "secret",
        r"[A-Za-z0-9_-]{24,}",
        f"""regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]') and len(list_distinct(string_split(hit, ''))) >= 8
              and regexp_matches(lower(substr(t, cast(greatest(start - 40, 0) + 1 as bigint), cast(least(start, 40) as bigint))), '{SECRET_WORDS}')""",
    ),
)
_PII_FOUND = " union all ".join(f"select doc_id, t, {r} as r, '{k}' as kind, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as hits from docs" for r, (k, p, _) in enumerate(_PII_SQL))
_PII_VALID = " ".join(f"when '{k}' then {v}" for k, _, v in _PII_SQL)



def _clusters_sql(rounds: int = 10) -> str:
    """The rounds one after the other, each vector held against every centroid."""
    distance = "cast(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    steps = [
        """v as materialized (
            select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q
            from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        )""",
        "c0 as materialized (select row_number() over (order by h, q) - 1 as c, q from (select q, sha256(concat('3:', cast(vec_id as varchar))) as h from v order by h, q limit 8))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select n, min((d, c)) as best from (select v.n, c.c, {distance} as d from v cross join c{r} c) group by n)")
        if r < rounds:
            steps.append(
                f"""s{r} as (
                    select c, list((s - ((s % k) + k) % k) // k order by i) as q
                    from (select a.best[2] as c, i, cast(sum(v.q[i]) as bigint) as s, count(*) as k from a{r} a join v on a.n = v.n, range(1, 65) as t(i) group by 1, 2)
                    group by c
                )"""
            )
            steps.append(f"c{r + 1} as materialized (select o.c, list_transform(coalesce(s.q, o.q), lambda x: cast(x as bigint)) as q from c{r} o left join s{r} s on o.c = s.c)")
    return f"""
        with {", ".join(steps)},
        o as (select v.vec_id, cast(a.best[2] as int) as cluster, a.best[1] as distance from a{rounds} a join v on a.n = v.n)
        select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
               cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
        from o join c{rounds} c on o.cluster = c.c
    """


ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _clusters_sql(),
    "op2_benchmark_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
        iw as (
            select distinct item, n, array_to_string(w[k : k + n - 1], ' ') as g
            from (select item, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0)
        ),
        dw as (
            select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as g
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d cross join (select distinct n from iw) where len(w) >= n)
        ),
        hits as (select doc_id, dw.n, k, item from dw join iw on dw.n = iw.n and dw.g = iw.g),
        pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from (select distinct doc_id, n, k from hits)) group by 1),
        its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hits group by 1)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join pos on d.doc_id = pos.doc_id left join its on d.doc_id = its.doc_id
    """,
    "op7_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as k from d where len(w) >= 50)),
        f as (select g, min(doc_id) as m from win group by g),
        gone as (select distinct doc_id, unnest(range(k, k + 50)) as p from win join f on win.g = f.g where doc_id > m),
        words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as s from words anti join gone using (doc_id, p) group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
        from d left join kept on d.doc_id = kept.doc_id
    """,
    "op10_pii": f"""
        with docs as (select doc_id, coalesce(text, '') as t from documents),
        found as ({_PII_FOUND}),
        one as (
            select doc_id, t, r, kind, hits[i] as hit, regexp_replace(hits[i], '[^0-9]', '', 'g') as digits,
                   cast(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0) as bigint) as start
            from (select *, unnest(range(1, len(hits) + 1)) as i from found)
        ),
        good as (select * from one where case kind {_PII_VALID} end),
        summed as (
            select doc_id, count(*) filter (where kind = 'email') as e, count(*) filter (where kind = 'ip') as i, count(*) filter (where kind = 'card') as c, count(*) filter (where kind = 'phone') as p,
                   string_agg(concat(kind, ':', start, ':', start + length(hit)), ',' order by start, r) as s,
                   string_agg(concat(kind, ':', start, ':', start + length(hit)), ',' order by start, r) filter (where kind <> 'secret') as base
            from good group by 1
        )
        select docs.doc_id, coalesce(e, 0) as n_email, coalesce(i, 0) as n_ip, coalesce(c, 0) as n_card, coalesce(p, 0) as n_phone,
               sha256(coalesce(base, '')) as base_sha256, coalesce(s, '') as spans, s is not null as has_pii
        from docs left join summed on docs.doc_id = summed.doc_id
    """,
    "op4_line_dedup": """
        with pages as (
            select row_number() over () as page, doc_id, text, coalesce(source, chr(0)) as host, string_split(text, chr(10)) as lines
            from documents
        ),
        seen as (
            select distinct page, host, trim(line) as line
            from (select page, host, unnest(lines) as line from pages)
            where trim(line) <> ''
        ),
        totals as (select host, count(*) as total from pages group by host),
        often as (
            select s.host, s.line
            from (select host, line, count(*) as n from seen group by host, line) s join totals t on s.host = t.host
            where s.n >= 2 and s.n > 0.1 * t.total
        ),
        flagged as (select host, list(line) as bad from often group by host),
        kept as (
            select p.*, list_filter(p.lines, lambda x: trim(x) = '' or not list_contains(coalesce(f.bad, []), trim(x))) as after
            from pages p left join flagged f on p.host = f.host
        )
        select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines,
               cast(coalesce(len(lines) - len(after), 0) as bigint) as n_dropped,
               sha256(coalesce(array_to_string(after, chr(10)), '')) as text_sha256
        from kept
    """,
    "op9_exact_top_k": """
        with v as (
            select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
            from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        s as (
            select a.n, a.vec_id as query_id, b.vec_id as vec_id,
                   cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
            from v a join v b on a.vec_id % 50 = 0 and a.n <> b.n
        ),
        r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
    """,
}
