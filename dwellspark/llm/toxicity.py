"""Toxicity by class-conditional Kneser-Ney models.

Each class (1: toxic, 0: ordinary) has a model of how words are spelled: P(character |
up to ``ORDER - 1`` characters before it in the word), with marks for a word's begin and
end.  With n counts of the class, N and T the sum and the number of different characters
after a history, D the discount and ``SHARED`` the weight of the shared model,

    P_class(b | h)  = (max(n - D, 0) + (SHARED + D * T) * P_shared(b | h)) / (N + SHARED)
    P_shared(b | h) = (max(n' - D, 0) + D * T' * P_cont(b | h')) / N'
    P_cont(b | h')  = (max(c - D, 0) + D * T'' * P_one(b)) / C

n', N', T' count both classes together, h' is h without its first character, and c is the
Kneser-Ney continuation count: the number of different characters that stand before h'b.
P_one are smoothed frequencies of characters, with a place for unknown ones.  So rare
expressions of a class are smoothed by what both classes share, and a word never seen is
judged by its parts.  All these sum to one (see the tests).

A toxic text is mostly made of ordinary words.  Its words are therefore a mixture, of
which ``TOXIC_SHARE`` come from the toxic model, and the rest from the ordinary one.  A
text's log-likelihoods under mixture and ordinary model are compared per word of the
text, and a logistic curve over that gives the score.

Counts are those of every labelled training text, but for one in ``CURVE`` of them, to
which the curve is fitted (if both classes are among these).  They are exact, keyed by the characters themselves, and grow
with the corpus.  What a word adds follows from two tables: the log ratio of every
seen (history, character), and that of every seen history for characters not seen after
it; other characters add nothing.  Up to ``BROADCAST_ROWS`` rows these are broadcast as
64-bit hashes (16 bytes each) and texts pass in one scan.  Beyond, words are joined to
them: each distinct word is judged once, and texts are joined to their words.

Labels are joined to texts by a broadcast up to ``BROADCAST_LABELS`` rows, else by a
shuffle.  Of several labels of an id the largest counts; null labels and ids are none.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased.
Null and empty texts have no words and a ratio of 0.  Without training texts of both
classes every score is 0.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import wordhash as W
from .shared import Packed, write_shared
from .workers import map_batches

ORDER = 8
DISCOUNT = 0.75
SHARED = 5.0
TOXIC_SHARE = 0.005
CURVE = 8
FOLDS = 5
BROADCAST_LABELS = 2_000_000
BROADCAST_ROWS = 8_000_000
#: The histogram of scaled ratios: bins of WIDTH, up to BINS to each side of 0.
BINS, WIDTH = 8000, 0.001
#: Scale of the normalised ratio before the curve.
ZOOM = 100.0
#: Penalty of the curve's slope.
RIDGE = 1e-6
#: Marks of a word's begin and end, which no word holds.
BEGIN, END = "\x02", "\x03"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words whose ratio a worker remembers.
MEMO_WORDS = 500_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _for_curve(doc_id: Column) -> Column:
    return F.floor(F.crc32(doc_id.cast("string")) / FOLDS) % CURVE == 0


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct words with their counts."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True):
            _, first, place = np.unique(W.word_hashes(c), return_index=True, return_inverse=True)
            toxic = label[c.first + W.owner(c.bounds, np.arange(len(c.starts)))] == 1
            n1 = np.bincount(place[toxic], minlength=len(first))
            n0 = np.bincount(place, minlength=len(first)) - n1
            raw = c.data.tobytes()
            words = [raw[a:b] for a, b in zip(c.starts[first].tolist(), c.ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n0), pa.array(n1)], names=["word", "n0", "n1"])


def count_words(texts: DataFrame) -> DataFrame:
    """word, n0, n1: how often each class of ``texts`` (text, label) has each word."""
    return map_batches(texts, _count_words, "word string, n0 long, n1 long").groupBy("word").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)))


def _grams(word: Column, order: int) -> Column:
    """The word's characters, its end included, each with its history."""
    marked = F.concat(F.lit(BEGIN), word, F.lit(END))
    return F.transform(F.sequence(F.lit(2), F.length(marked)), lambda i: F.substr(marked, F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))))


def _history(gram: Column) -> Column:
    return F.substr(gram, F.lit(1), F.length(gram) - 1)


def _less(n: Column) -> Column:
    return F.greatest(n - DISCOUNT, F.lit(0.0))


def _share(k: int) -> Column:
    """The weight of the shared model after a history, in class k."""
    return (SHARED + DISCOUNT * F.col(f"t{k}")) / (F.col(f"s{k}") + SHARED)


def class_models(vocabulary: DataFrame, *, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """history, char, shared, p0, p1 of all that were seen; and history, share0, share1: the weights of the shared model."""
    each = vocabulary.select(F.explode(_grams(F.col("word"), order)).alias("gram"), "n0", "n1")
    grams, _ = write_shared(each.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    seen = grams.select(_history(F.col("gram")).alias("history"), F.substr("gram", F.length("gram"), F.lit(1)).alias("char"), "n0", "n1").withColumn("lower", F.substr("history", F.lit(2), F.length("history")))
    after = seen.groupBy("history").agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in (0, 1)), *(F.count_if(F.col(f"n{k}") > 0).alias(f"t{k}") for k in (0, 1)), F.count("*").alias("t"))
    continued = seen.groupBy("lower", "char").agg(F.count("*").alias("c"))
    lower = continued.groupBy("lower").agg(F.sum("c").alias("cs"), F.count("*").alias("ct"))
    single = seen.groupBy("char").agg(F.sum(F.col("n0") + F.col("n1")).alias("u"))
    places, all_ = single.agg(F.count("*"), F.coalesce(F.sum("u"), F.lit(0))).first()
    one = (F.col("u") + 1) / float(all_ + places + 1)
    cont = (_less(F.col("c")) + DISCOUNT * F.col("ct") * one) / F.col("cs")
    shared = (_less(F.col("n0") + F.col("n1")) + DISCOUNT * F.col("t") * cont) / (F.col("s0") + F.col("s1"))
    own = lambda k: _less(F.col(f"n{k}")) / (F.col(f"s{k}") + SHARED) + _share(k) * F.col("shared")
    joined = seen.join(after, "history").join(continued, ["lower", "char"]).join(lower, "lower").join(single, "char")
    models = joined.withColumn("shared", shared).select("history", "char", "shared", own(0).alias("p0"), own(1).alias("p1"))
    return models, after.select("history", _share(0).alias("share0"), _share(1).alias("share1"))


def evidence(vocabulary: DataFrame, *, order: int = ORDER) -> DataFrame:
    """part, whole, value: the log ratio of a seen history and character (whole), or of others after a seen history."""
    models, weights = class_models(vocabulary, order=order)
    seen = models.select(F.concat("history", "char").alias("part"), F.lit(True).alias("whole"), F.log(F.col("p1") / F.col("p0")).alias("value"))
    return seen.union(weights.select(F.col("history").alias("part"), F.lit(False).alias("whole"), F.log(F.col("share1") / F.col("share0")).alias("value")))


def _key(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, whole: bool | np.ndarray) -> np.ndarray:
    """The hash of a part from that of its characters without marks."""
    return W.mix(raw + W.U64(1) + (begins * 2 + ends * 4 + whole * np.uint8(8)).astype(W.U64) * W.U64(W.GRAM_BASES[0]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = W.text_buffers(batch.column("part"))
        begins = data[at[:-1]] == ord(BEGIN)
        ends = data[at[1:] - 1] == ord(END)
        sums, down = W.byte_sums(W.Chunk(0, data, at, at, at))
        low, high = at[:-1] + begins, at[1:] - ends
        raw = (sums[high] - sums[low]) * down[low]
        key = _key(raw, begins.astype(np.uint8), ends.astype(np.uint8), batch.column("whole").to_numpy(zero_copy_only=False).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("value")], names=["key", "value"])


def word_ratios(chunk: W.Chunk, words: np.ndarray, keys: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of some words (numbers of the chunk)."""
    begin, end = chunk.starts[words], chunk.ends[words]
    starts = (chunk.data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    place = np.append(np.flatnonzero(starts), len(chunk.data))
    first, size = before[begin], before[end] - before[begin]
    word = np.repeat(np.arange(len(words)), size + 1)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1) + 1  # 1: first character, size + 1: the end
    low = np.maximum(at - order + 1, 0)
    last = (at > size[word]).astype(np.uint8)
    fresh = (low == 0).astype(np.uint8)
    a = np.where(low == 0, begin[word], place[np.minimum(first[word] + np.maximum(low, 1) - 1, len(place) - 1)])
    b = np.where(at < size[word], place[np.minimum(first[word] + at, len(place) - 1)], end[word])
    h = np.where(last == 1, end[word], place[np.minimum(first[word] + at - 1, len(place) - 1)])
    sums, down = W.byte_sums(chunk)
    found = _key((sums[b] - sums[a]) * down[a], fresh, last, np.uint8(1))
    where = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    seen = keys[where] == found
    out = np.where(seen, values[where], 0.0)
    rest = np.flatnonzero(~seen)
    found = _key((sums[h[rest]] - sums[a[rest]]) * down[a[rest]], fresh[rest], np.zeros(len(rest), np.uint8), np.uint8(0))
    where = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    out[rest] = np.where(keys[where] == found, values[where], 0.0)
    return np.bincount(word, out, minlength=len(words))


def _scan(model, order: int, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's mean over its words, with the broadcast tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = model.value
        known, ratios = np.zeros(0, W.U64), np.zeros(0)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for c in W.chunks(W.text_of(batch, text), W.ALNUM_BYTES, lower=True):
                hashes, first, place = np.unique(W.word_hashes(c), return_index=True, return_inverse=True)
                new = np.flatnonzero(~W.member(hashes, known))
                own = np.zeros(len(hashes))
                if len(new):
                    own[new] = np.log1p(TOXIC_SHARE * np.expm1(np.minimum(word_ratios(c, first[new], keys, values, order), 700.0)))
                old = np.setdiff1d(np.arange(len(hashes)), new, assume_unique=True)
                own[old] = ratios[np.searchsorted(known, hashes[old])]
                if len(new) and len(known) < MEMO_WORDS:
                    known, ratios = np.concatenate([known, hashes[new]]), np.concatenate([ratios, own[new]])
                    order_ = np.argsort(known, kind="stable")
                    known, ratios = known[order_], ratios[order_]
                sums = np.concatenate([[0.0], np.cumsum(own[place])])
                out[c.first : c.first + len(c.bounds) - 1] = (sums[c.bounds[1:]] - sums[c.bounds[:-1]]) / np.maximum(np.diff(c.bounds), 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "mean"])

    return run


def _joined(rows: DataFrame, table: DataFrame, order: int, text: Column) -> DataFrame:
    """The same with joins: ``rows`` (column row) and their mean."""
    numbered, _ = write_shared(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
    words = numbered.select("number", F.explode(words_of(text)).alias("word")).groupBy("number", "word").agg(F.count("*").alias("n"))
    words, _ = write_shared(words, "words")
    parts = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"), order)).alias("gram"))
    seen = table.filter("whole").select(F.col("part").alias("gram"), F.col("value").alias("own"))
    rest = table.filter("not whole").select(F.col("part").alias("history"), F.col("value").alias("other"))
    judged = parts.join(seen, "gram", "left").withColumn("history", _history(F.col("gram"))).join(rest, "history", "left")
    ratio = F.least(F.sum(F.coalesce("own", "other", F.lit(0.0))), F.lit(700.0))
    of_word = judged.groupBy("word").agg(F.log1p(F.lit(TOXIC_SHARE) * F.expm1(ratio)).alias("ratio"))
    mean = words.join(of_word, "word").groupBy("number").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("mean"))
    return numbered.join(mean, "number", "left").select("row", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def _means(packed: Packed, rows: DataFrame, model, table: DataFrame, order: int, text: str) -> DataFrame:
    body = packed.field(text).cast("string")
    if model is None:
        return _joined(rows, table, order, body)
    schema = StructType([*rows.select("row").schema.fields, StructField("mean", DoubleType())])
    return map_batches(rows, _scan(model, order, f"c{packed.index(text)}"), schema)


def fit_curve(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton's method."""
    x = (bins + 0.5) * WIDTH
    scale = float(np.sqrt((weights * x * x).sum() / weights.sum())) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (labels - p)) - RIDGE * weights.sum() * beta * [1, 0]
        hessian = (design * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + RIDGE * weights.sum() * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _scaled() -> Column:
    return F.asinh(F.col("mean") * ZOOM)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", order: int = ORDER, broadcast_labels: int = BROADCAST_LABELS, broadcast_rows: int = BROADCAST_ROWS
) -> tuple[Packed, DataFrame]:
    """``docs`` packed, and their rows with score (double), learnt from labelled rows outside fold 0."""
    spark = docs.sparkSession
    packed = Packed(docs)
    rows = packed.rows
    of_labels = Packed(labels)
    known = of_labels.rows.select(of_labels.field(doc_id).alias("key"), of_labels.field(label).cast("int").alias("label")).filter("key is not null and label is not null")
    known = known.filter(fold(F.col("key")) != 0).groupBy("key").agg(F.max("label").alias("label"))
    if known.count() <= broadcast_labels:
        known = F.broadcast(known)
    labelled = rows.withColumn("key", packed.field(doc_id)).join(known, "key")
    learnt = labelled.filter(~_for_curve(F.col("key"))).select(packed.field(text).cast("string").alias("text"), "label")
    vocabulary, _ = write_shared(count_words(learnt), "vocabulary")
    if not all(vocabulary.agg(F.coalesce(F.max("n0"), F.lit(0)), F.coalesce(F.max("n1"), F.lit(0))).first()):
        return packed, rows.withColumn("score", F.lit(0.0))
    table, _ = write_shared(evidence(vocabulary, order=order), "evidence")
    model = None
    if table.count() <= broadcast_rows:
        hashed = map_batches(table, _hashed, "key long, value double").toArrow()  # at most broadcast_rows rows of 16 bytes
        keys = hashed["key"].to_numpy().view(W.U64)
        by_key = np.argsort(keys)
        model = spark.sparkContext.broadcast((keys[by_key], hashed["value"].to_numpy()[by_key].astype(np.float32)))
    marked = labelled.select(_for_curve(F.col("key")).alias("apart"), packed.field(text).cast("string").alias("text"), "label")
    if marked.filter("apart").select("label").distinct().count() > 1:
        marked = marked.filter("apart")
    fitted = Packed(marked.select("text", "label"))
    bins = F.least(F.greatest(F.floor(_scaled() / WIDTH), F.lit(-BINS)), F.lit(BINS - 1))
    counts = _means(fitted, fitted.rows, model, table, order, "text").groupBy(fitted.field("label").alias("label"), bins.alias("bin")).agg(F.count("*").alias("n")).toArrow()  # at most 4 * BINS rows
    slope, intercept = fit_curve(*(counts[k].to_numpy().astype(float) for k in ("bin", "label", "n")))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(_scaled() * slope + intercept)))
    return packed, _means(packed, rows, model, table, order, text).select("row", score.alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with held_out, score and predicted, which replace columns of those names."""
    packed, scored = toxicity_scores(docs, labels, doc_id=doc_id, text=text, **options)
    score = F.col("score")
    return packed.unpack_with(scored, held_out=fold(packed.field(doc_id)) == 0, score=score, predicted=(score >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` whose score is below one half, with their own columns only."""
    packed, scored = toxicity_scores(docs, labels, **options)
    return packed.unpack(scored.filter("score < 0.5"))
