"""Benchmark decontamination by winnowing.

A *window* is ``span`` consecutive words of a benchmark item; an item of fewer
words (but some) is one window.  A document word is hit if it lies inside any
occurrence of a window.

Winnowing keeps, of every run of ``span - gram + 1`` consecutive word
``gram``-grams, the smallest hash.  Two texts that share ``span`` words share such
a run and so a kept hash; therefore documents that share no kept hash with an item
hold none of its windows.  Around each kept hash that an item shares, all windows
of the document that hold it are compared with the items' windows by a 128-bit hash.
Items shorter than a window are winnowed with their own length as gram.

The items' fingerprints and windows are counted first.  Up to ``BROADCAST_WINDOWS``
they are broadcast (28 bytes each, and the items' ids once for each set of items that
share windows) and documents pass in one scan; beyond, both steps are shuffle joins of
hashes with row numbers, and texts are shuffled only for documents that share a hash.

Null and empty texts have no words, are never hit and stay.  Item ids are compared
as strings (null as "null"); repeated items count once.  Repeated documents each
get their row.  Extra columns pass through ``decontaminate`` and never clash, as rows
are carried as one column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import wordhash as W
from .idset import maybe_in
from .shared import Packed, write_shared
from .workers import map_batches

SPAN = 13
GRAM = 5
#: A twentieth of the words.
MIN_SHARE = 20
#: Windows of the benchmark up to which they are broadcast (32 bytes each).
BROADCAST_WINDOWS = 1_000_000

WINDOWS = "n int, h1 long, h2 long, item string"
FINGERPRINTS = "n int, h1 long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _item_windows(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True):
                h = [W.word_hashes(c, k) for k in (0, 1)]
                for i, (a, b) in enumerate(zip(c.bounds[:-1], c.bounds[1:], strict=True)):
                    if a == b:
                        continue
                    n = min(span, b - a)
                    g = [W.gram_hashes(x[a:b], n, k) for k, x in enumerate(h)]
                    yield pa.record_batch(
                        [pa.array(np.full(len(g[0]), n, np.int32)), pa.array(_signed(g[0])), pa.array(_signed(g[1])), pa.array([ids[c.first + i]] * len(g[0]), pa.string())],
                        names=["n", "h1", "h2", "item"],
                    )

    return run


def _fingerprints_of(h: np.ndarray, bounds: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams of whole windows."""
    g = W.gram_hashes(h, gram)
    at = W.winnow(g, W.inside_one_text(bounds, gram), span - gram + 1)
    return at, g[at]


def _item_fingerprints(span: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True):
                h = W.word_hashes(c)
                _, kept = _fingerprints_of(h, c.bounds, span, gram)
                yield pa.record_batch([pa.array(np.full(len(kept), span, np.int32)), pa.array(_signed(kept))], names=["n", "h1"])
                sizes = np.diff(c.bounds)
                for i in np.flatnonzero((sizes > 0) & (sizes < span)):
                    g = W.gram_hashes(h[c.bounds[i] : c.bounds[i + 1]], int(sizes[i]))
                    yield pa.record_batch([pa.array(np.array([sizes[i]], np.int32)), pa.array(_signed(g))], names=["n", "h1"])

    return run


def _by_length(n: np.ndarray, *columns: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    return {int(k): tuple(x[n == k] for x in columns) for k in np.unique(n)}


class _Probe:
    """Finds the windows of documents around shared fingerprints."""

    def __init__(self, fingerprints: dict[int, np.ndarray], span: int, gram: int):
        self.fingerprints, self.span, self.gram = fingerprints, span, gram

    def windows(self, c: W.Chunk, h: np.ndarray, second: Callable[[], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window length: positions and the two hashes of windows that hold a shared fingerprint."""
        total = len(h)
        for n, kept in self.fingerprints.items():
            if n == self.span:
                at, g = _fingerprints_of(h, c.bounds, n, self.gram)
                at = at[W.member(g, kept)]
                back = n - self.gram
            else:
                g = W.gram_hashes(h, n)
                at = np.flatnonzero(W.inside_one_text(c.bounds, n) & W.member(g, kept))
                back = 0
            if not len(at) or total < n:
                continue
            near = W.cover(np.maximum(at - back, 0), at - np.maximum(at - back, 0) + 1, total)[: total - n + 1]
            at = np.flatnonzero(near & W.inside_one_text(c.bounds, n))
            if len(at):
                yield n, at, W.gram_hashes(h, n)[at], W.gram_hashes(second(), n, 1)[at]


def _scan(shared, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One scan of documents against broadcast fingerprints and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprints, windows, names, span, gram = shared.value
        probe = _Probe(fingerprints, span, gram)
        for batch in batches:
            rows = batch.num_rows
            n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            items: list[set[str]] = [set() for _ in range(rows)]
            for c in W.chunks(W.text_of(batch, text), W.ALNUM_BYTES, lower=True):
                sizes = np.diff(c.bounds)
                n_words[c.first : c.first + len(sizes)] = sizes
                h = W.word_hashes(c)
                hit = np.zeros(len(h), bool)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for n, at, h1, h2 in probe.windows(c, h, lambda c=c: W.word_hashes(c, 1)):
                    w1, w2, group = windows[n]
                    low, high = np.searchsorted(w1, h1), np.searchsorted(w1, h1, side="right")
                    row = np.repeat(np.arange(len(at)), high - low)  # windows are distinct: high - low is 1, but for collisions of h1
                    entry = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
                    same = w2[entry] == h2[row]
                    row, entry = row[same], entry[same]
                    if len(row):
                        hit |= W.cover(at[row], n, len(h))
                        pairs = np.unique(np.stack([W.owner(c.bounds, at[row]), group[entry]], axis=1), axis=0)
                        found.append((pairs[:, 0], pairs[:, 1]))
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit[c.first : c.first + len(sizes)] = sums[c.bounds[1:]] - sums[c.bounds[:-1]]
                for docs, groups in found:
                    for d, g in zip(docs, groups, strict=True):
                        items[c.first + d].update(names[g])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["row", "n_words", "n_hit", "items"]
            )

    return run


def _kept_grams(lengths: list[int], span: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's distinct kept grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True):
                h = W.word_hashes(c)
                for n in lengths:
                    if n == span:
                        at, g = _fingerprints_of(h, c.bounds, span, gram)
                    else:
                        g = W.gram_hashes(h, n)
                        at = np.flatnonzero(W.inside_one_text(c.bounds, n))
                        g = g[at]
                    row, at = W.owner(c.bounds, at), g
                    both = np.unique(np.stack([row.astype(np.int64), _signed(at)], axis=1), axis=0)
                    yield pa.record_batch([keys.take(pa.array(both[:, 0] + c.first)), pa.array(np.full(len(both), n, np.int32)), pa.array(both[:, 1])], names=["key", "n", "h1"])

    return run


def _candidate_windows(span: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of documents that come with their shared fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shared = batch.column("key"), batch.column("shared").to_pylist()
            for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True, limit=1):
                own = shared[c.first]
                prints = _by_length(np.array([x["n"] for x in own]), np.array([x["h1"] for x in own], np.int64).view(np.uint64))
                probe = _Probe({n: np.sort(x[0]) for n, x in prints.items()}, span, gram)
                for n, at, h1, h2 in probe.windows(c, W.word_hashes(c), lambda c=c: W.word_hashes(c, 1)):
                    yield pa.record_batch(
                        [pa.array([keys[c.first].as_py()] * len(at), pa.int64()), pa.array(np.full(len(at), n, np.int32)), pa.array(_signed(h1)), pa.array(_signed(h2)), pa.array(at.astype(np.int64))],
                        names=["key", "n", "h1", "h2", "at"],
                    )

    return run


def _count_words(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for c in W.chunks(W.text_of(batch, text), W.ALNUM_BYTES):
                n[c.first : c.first + len(c.bounds) - 1] = np.diff(c.bounds)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), pa.array(n)], names=["row", "doc", "n_words"])

    return run


def _covered(runs: Column) -> Column:
    """Positions inside any of the runs (struct at, n), which are sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, r: F.struct(
        F.greatest(a["end"], r["at"] + r["n"]).alias("end"),
        (a["sum"] + F.greatest(r["at"] + r["n"] - F.greatest(a["end"], r["at"]), F.lit(0))).cast("long").alias("sum"),
    )
    return F.aggregate(runs, zero, step, lambda a: a["sum"])


def contaminated_rows(
    docs: DataFrame, items: DataFrame, *, span: int = SPAN, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> tuple[Packed, DataFrame]:
    """``docs`` packed, and their rows with n_words, n_hit (long) and items (array of the ids whose windows occur)."""
    spark = docs.sparkSession
    of_items = Packed(items)
    source = of_items.rows.select(F.coalesce(of_items.field(item_id).cast("string"), F.lit("null")).alias("item"), of_items.field(item_text).cast("string").alias("text"))
    windows, _ = write_shared(map_batches(source, _item_windows(span), WINDOWS).distinct(), "windows")
    prints, _ = write_shared(map_batches(source.select("text"), _item_fingerprints(span, gram), FINGERPRINTS).distinct(), "fingerprints")
    packed = Packed(docs)
    column = f"c{packed.index(text)}"
    fields = packed.rows.schema.fields

    if windows.count() <= broadcast_windows:
        each = windows.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
        sets = each.groupBy("items").agg(F.collect_list(F.struct("n", "h1", "h2")).alias("of")).toArrow()  # at most broadcast_windows windows; ids once for each set
        names = sets["items"].to_pylist()
        rows = [(w["n"], w["h1"], w["h2"], g) for g, of in enumerate(sets["of"].to_pylist()) for w in of]
        w = np.array(rows, np.int64).reshape(-1, 4)
        w = w[np.argsort(w[:, 1].view(np.uint64), kind="stable")]
        u = lambda x: np.ascontiguousarray(x).view(np.uint64)
        by_n = _by_length(w[:, 0], u(w[:, 1]), u(w[:, 2]), w[:, 3])
        p = prints.toArrow()
        fps = {n: np.sort(x[0]) for n, x in _by_length(p["n"].to_numpy(), u(p["h1"].to_numpy())).items()}
        shared = spark.sparkContext.broadcast((fps, by_n, names, span, gram))
        schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))])
        return packed, map_batches(packed.rows, _scan(shared, column), schema)

    lengths = [r["n"] for r in prints.select("n").distinct().collect()]  # at most span values
    rows, _ = write_shared(packed.rows.withColumn("doc", F.monotonically_increasing_id()), "documents")
    texts = rows.select("doc", packed.field(text).cast("string").alias("text"))
    hits = map_batches(texts.select(F.col("doc").alias("key"), "text"), _kept_grams(lengths, span, gram), "key long, n int, h1 long").join(prints, ["n", "h1"], "left_semi").distinct()
    shared_prints, _ = write_shared(hits.groupBy(F.col("key").alias("doc")).agg(F.collect_list(F.struct("n", "h1")).alias("shared")), "shared")
    candidates = maybe_in(texts, shared_prints.select("doc"))[1].join(shared_prints, "doc").select(F.col("doc").alias("key"), "text", "shared")
    found = (
        map_batches(candidates, _candidate_windows(span, gram), "key long, n int, h1 long, h2 long, at long")
        .join(windows, ["n", "h1", "h2"])
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("runs"), F.collect_set("item").alias("items"))
        .select(F.col("key").alias("doc"), _covered(F.col("runs")).alias("n_hit"), "items")
    )
    found, _ = write_shared(found, "found")
    counted = map_batches(rows, _count_words(column), StructType([*fields, StructField("doc", LongType()), StructField("n_words", LongType())]))
    clean, hit = maybe_in(counted, found.select("doc"))
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")]
    joined = hit.join(found, "doc", "left").select("row", "n_words", F.coalesce("n_hit", none[0]).alias("n_hit"), F.coalesce("items", none[1]).alias("items"))
    return packed, clean.select("row", "n_words", *none).union(joined)


def is_contaminated(n_words: Column, n_hit: Column, min_share: int = MIN_SHARE) -> Column:
    return (n_hit > 0) & (min_share * n_hit >= n_words)


def find_contamination(docs: DataFrame, items: DataFrame, *, min_share: int = MIN_SHARE, **options) -> DataFrame:
    """``docs`` with ``contamination``: n_words, n_hit, items and contaminated as one struct, which replaces a column of that name."""
    packed, rows = contaminated_rows(docs, items, **options)
    return packed.unpack_with(rows, contamination=F.struct("n_words", "n_hit", "items", is_contaminated(F.col("n_words"), F.col("n_hit"), min_share).alias("contaminated")))


def decontaminate(docs: DataFrame, items: DataFrame, *, min_share: int = MIN_SHARE, **options) -> DataFrame:
    """The documents of which less than one ``min_share``-th of the words is hit, with all their columns unchanged."""
    packed, rows = contaminated_rows(docs, items, **options)
    return packed.unpack(rows.filter(~is_contaminated(F.col("n_words"), F.col("n_hit"), min_share)))
