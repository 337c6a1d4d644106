"""What answers a question about listings: evidence by category, fields that a question names, searches of many questions at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text, vectors
from ..session import ship_package
from .places import either_holds
from .retrieval import bm25


#: Rows of a block of vectors, and of queries.
BLOCK = 2048


def _blocks(df: DataFrame, number: str, name: str, n: int) -> DataFrame:
    """``df`` (key, vector, tokens) dealt to n blocks by a hash of its key, a row for each block: its number and its rows."""
    return df.withColumn(number, F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).groupBy(number).agg(F.collect_list(F.struct("key", "vector", "tokens")).alias(name))


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; -1 for those that are null or hold a null."""
    out, sizes = np.zeros((len(lists), width)), np.full(len(lists), -1)
    if lists.null_count == 0 and lists.flatten().null_count == 0 and len(lists.flatten()) == out.size:
        if (lists.value_lengths().to_numpy() == width).all():
            return lists.flatten().to_numpy().astype(np.float64).reshape(out.shape), np.full(len(lists), width)
    for i, x in enumerate(lists.to_pylist()):
        if x is not None and None not in x:
            out[i, : len(x)], sizes[i] = x, len(x)
    return out, sizes


def _wanted(asked: pa.Array, held: pa.Array) -> np.ndarray:
    """Which queries (rows) want which rows: those that share a token, or all, for a query without tokens."""
    names: dict[str, int] = {}
    number = lambda lists: [[names.setdefault(t, len(names)) for t in x or []] for x in lists.to_pylist()]
    left, right = number(asked), number(held)
    out = np.zeros((len(left), len(right)), bool)
    rows: dict[int, list[int]] = {}
    for i, x in enumerate(right):
        for t in set(x):
            rows.setdefault(t, []).append(i)
    for i, x in enumerate(left):
        if not x:
            out[i] = True
        for t in set(x):
            out[i, rows.get(t, [])] = True
    return out


def _best_of_blocks(n: int):
    """The n best rows of each query in a pair of blocks.

    Products of matrices leave out what can't be among them; the rest is added up in the vectors'
    order, as a fold does.  Vectors of other lengths or with nulls have no score, and go last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = batch.column("asked")[i].values, batch.column("held")[i].values
                width = max([*asked.field("vector").value_lengths().drop_null().to_pylist(), *held.field("vector").value_lengths().drop_null().to_pylist()], default=0)
                (q, q_size), (v, v_size) = (_matrix(x.field("vector"), width) for x in (asked, held))
                wanted, known = _wanted(asked.field("tokens"), held.field("tokens")), (q_size[:, None] == v_size) & (q_size >= 0)[:, None]
                with np.errstate(all="ignore"):
                    near = q @ v.T
                    near[np.isnan(near)] = np.inf  # the largest, in Spark's order
                    near[~(wanted & known)] = -np.inf
                    # sums in another order differ by no more than this
                    slack = 4 * (width + 1) * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0.0)
                    last = np.partition(near, -n, axis=1)[:, -n] if near.shape[1] > n else np.full(len(q), -np.inf)
                    at, to = np.nonzero(wanted & ~(near < (last - slack)[:, None]))
                    score = np.zeros(len(at))
                    for k in range(width):
                        score += q[at, k] * v[to, k]
                yield pa.RecordBatch.from_arrays([asked.field("key").take(pa.array(at)), held.field("key").take(pa.array(to)), pa.array(score, mask=~known[at, to])], names=["query", "key", "score"])

    return run


def filtered_vector_top(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """query, rank, key, score: the n rows nearest to each query by inner product, among those that share a token with it.

    ``queries``: query, vector, tokens; ``rows``: key, vector, tokens.  A query without tokens takes all rows, so the work is queries times rows by nature.  Both are dealt
    to blocks, every pair of blocks is a product of matrices in a task, and only the n best of
    a query leave it (with those that rounding could put among them).  Ties go to the smaller key.
    """
    spark = rows.sparkSession
    sized = lambda df: max(1, -(-df.count() // BLOCK))
    many = sized(rows)
    asked = _blocks(queries.filter("query is not null").withColumnRenamed("query", "key"), "_a", "asked", sized(queries))
    held = _blocks(rows, "_b", "held", many)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = asked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(held, "_b")
    ship_package(spark)
    found = met.repartition(tasks, "_a", "_b").mapInArrow(_best_of_blocks(n), T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("score", T.DoubleType())]))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("query", "rank", "key", "score")


def evidence(chunks: DataFrame, terms: Mapping[str, Sequence[str]], *, key: str, n: int = fixed.EVIDENCE_TOP) -> DataFrame:
    """key, category, rank, place, score: the n best chunks of each listing for each category that has terms.

    ``chunks``: key, field, place (the order in the listing), text, and ``sims`` (map of category
    to the cosine of the chunk and the category's terms).  A category looks at its fields; there
    a chunk's score is the larger of its BM25, relative to the listing's best, and its cosine.
    Of equal texts the first counts.  A listing without evidence in any category falls back to
    all its fields, under "general", with all terms; windows decide that, in one plan.
    """
    named = {c: list(t) for c, t in terms.items() if t}
    all_terms = [t for words in named.values() for t in words]

    def of(category: str, words: Sequence[str]) -> DataFrame:
        own = chunks.filter(F.col("field").isin(*fixed.CATEGORY_FIELDS.get(category, fixed.CATEGORY_FIELDS["general"])))
        lexical = bm25(own.select(key, "place", "text"), words or [""], key="place", body="text", corpus=[key])
        met = own.join(lexical, [key, "place"], "left").withColumn("b", F.coalesce("score", F.lit(0.0)))
        best = F.max("b").over(Window.partitionBy(key))
        sim = vectors.clipped_cosine(F.coalesce(F.col("sims")[category], F.lit(0.0)))
        scored = met.withColumn("score", F.bround(F.greatest(F.col("b") / (F.when(best > 0, best).otherwise(1.0) + 1e-8), sim), 4))
        first = scored.withColumn("copy", F.row_number().over(Window.partitionBy(key, "text").orderBy("place"))).filter("copy = 1")
        order = Window.partitionBy(key).orderBy(F.desc("score"), "place")
        return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(key, F.lit(category).alias("category"), "rank", "place", "score")

    found = [of(c, words) for c, words in named.items()]
    general = of("general", all_terms)
    both = reduce(DataFrame.union, [*found, general])
    # a category of its own named "general" is not the fallback
    has = F.max(F.when(F.col("category") != "general", 1).otherwise(0)).over(Window.partitionBy(key))
    return both.withColumn("has", has).filter((F.col("category") != "general") | (F.col("has") == 0)).drop("has")


def singular(c: Column) -> Column:
    """Letters and digits in lower case, without the last s of longer words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", ""), "^(...+)s$", "$1")


def paths(schema: T.StructType, before: str = "") -> list[tuple[str, str]]:
    """The leaves of a record: column path and name (parts joined by underscores); arrays are leaves."""
    out = []
    for f in schema.fields:
        path, name = f"{before}`{f.name}`", f.name
        if isinstance(f.dataType, T.StructType):
            out += [(p, f"{name}_{n}") for p, n in paths(f.dataType, f"{path}.")]
        else:
            out.append((path, name))
    return out


def is_empty(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*fixed.EMPTY_VALUES)


def unpivoted(records: DataFrame, key: str, without: Sequence[str] = ()) -> DataFrame:
    """key, field, ord, value: a row for each leaf of a record that isn't empty, lists as JSON; fields come from the schema, nested ones too."""
    leaves = [(p, n) for p, n in paths(records.schema) if n != key and n not in without]
    kinds = {p: t for p, t in records.select(*(F.expr(p).alias(p) for p, _ in leaves)).dtypes}
    value = lambda p: F.to_json(F.expr(p)) if kinds[p].startswith(("array", "map")) else F.expr(p).cast("string")
    entries = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(i).alias("ord"), value(p).alias("value")) for i, (p, n) in enumerate(leaves)))
    return records.select(key, F.explode(entries).alias("e")).select(key, "e.*").filter(~is_empty(F.col("value")))


def structured_lookup(questions: DataFrame, records: DataFrame, *, key: str, without: Sequence[str] = fixed.UNSTRUCTURED_FIELDS) -> DataFrame:
    """question, field, item: the fields of its record that a question's terms name, an item a row.

    ``questions``: question, key, terms (array).  A term names a field if one holds the other, both
    without marks and a last s.  The distinct terms meet the field names by their runs of letters.
    """
    fields = unpivoted(records, key, without)
    names = records.sparkSession.createDataFrame([(n,) for _, n in paths(records.schema)], "field string").filter(~F.col("field").isin(key, *without)).withColumn("name", singular(F.col("field")))
    asked = questions.select("question", key, F.explode("terms").alias("t")).select("question", key, singular(F.col("t")).alias("typed")).filter("typed <> ''").distinct()
    met = either_holds(asked.select("typed").distinct(), names.select("name").distinct()).join(F.broadcast(names), "name").select("typed", "field")  # a row for each field of the schema
    hits = asked.join(met, "typed").select("question", key, "field").distinct().join(fields, [key, "field"])
    return hits.select("question", "field", F.explode(text.jsonish_items(F.col("value"))).alias("item"))
