"""Substring dedup: long repeats found by recompression and verified.

Of every run of ``window`` words that also starts in a document with a smaller id, the
words are removed.  All runs are judged on the input.

1. Whole copies: of equal texts all but the one with the smallest id are copies; all
   their windows repeat.  They take no further part.  Other rows of their ids do.
2. Every document is recompressed (see ``recompression``), and (name, doc) of its
   symbols is shuffled; names in two documents or more are shared.
3. A window that holds a symbol which depends on its words alone, and whose name isn't
   shared, occurs nowhere else.  All other windows of documents with shared symbols are
   candidates.  (Documents with windows too uniform to hold such a symbol always count.)
4. Candidates are compared whole, by a 128-bit hash: the smallest document of each is a
   partial aggregate, and a plain join gives the windows that repeat.
5. The words they cover are removed.

Hot names, passages and copies: counts are combined before shuffles, and joins are plain
joins that Spark can split.  Texts are shuffled only for documents that need it: a bitmap
of bounded size over hashed ids keeps nearly all others out of the joins.  Chunks bound
what a task holds, so arrays aren't given back one by one, which costs CPU time.

Null and empty texts have no words.  Rows with null ids count as largest, as one id.  Rows
that share an id are one document.  Other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .idset import maybe_in
from .recompression import ROUNDS, Symbols, recompress
from .shared import drop_shared, write_shared
from .workers import map_batches

WINDOW = 50
LAST_ID = (1 << 63) - 1


def _unsure(s: Symbols, bounds: np.ndarray, window: int, total: int, unshared: np.ndarray | None = None) -> np.ndarray:
    """Starts of windows that hold no symbol (of ``unshared``) which depends on their words alone."""
    inside = np.zeros(total, bool)
    whole = W.inside_one_text(bounds, window)
    inside[: len(whole)] = whole
    low = np.maximum(s.high - window, bounds[s.text])
    high = np.minimum(s.low, bounds[s.text + 1] - window)
    some = low <= high
    if unshared is not None:
        some &= unshared
    return inside & ~W.cover(low[some], (high - low + 1)[some], total) if some.any() else inside


def _names(window: int, rounds: int):
    """Distinct (name, doc) of a chunk's symbols; sure is false in the row of a document that is too uniform."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for c in W.chunks(batch.column("text"), W.NON_SPACE_BYTES):
                s = recompress(W.word_hashes(c), c.bounds, rounds)
                long = (np.diff(c.bounds) >= window)[s.text]
                order = np.lexsort((s.name[long], s.text[long]))
                name, text = s.name[long][order], s.text[long][order]
                new = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])]) if len(name) else np.zeros(0, bool)
                unsure = np.unique(W.owner(c.bounds, np.flatnonzero(_unsure(s, c.bounds, window, len(c.starts)))))
                names = np.concatenate([name[new], W.mix(unsure.astype(np.uint64))])
                docs = ids[c.first + np.concatenate([text[new], unsure])]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(docs), pa.array(np.arange(len(names)) < new.sum())], names=["name", "doc", "sure"])

    return run


def _candidates(window: int, rounds: int):
    """Distinct hashes of the candidate windows of documents that come with their shared names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column("doc").to_numpy(), batch.column("names")
            for c in W.chunks(batch.column("text"), W.NON_SPACE_BYTES):
                h = W.word_hashes(c)
                if len(h) < window:
                    continue
                s = recompress(h, c.bounds, rounds)
                unshared = np.ones(len(s.name), bool)
                cuts = np.searchsorted(s.text, np.arange(len(c.bounds)))
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    own = np.sort(shared[c.first + i].values.to_numpy().view(np.uint64))
                    unshared[a:b] = ~W.member(s.name[a:b], own)
                at = np.flatnonzero(_unsure(s, c.bounds, window, len(h), unshared))
                h1, h2 = W.gram_hashes(h, window)[at], W.gram_hashes(W.word_hashes(c, 1), window, 1)[at]
                text = W.owner(c.bounds, at)
                order = np.lexsort((h1, text))
                h1, h2, text = h1[order], h2[order], text[order]
                new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)), pa.array(ids[c.first + text[new]])], names=["h1", "h2", "doc"])

    return run


def _held(g1: np.ndarray, g2: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Places whose pair of hashes is among the pairs (h1, h2)."""
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    low, high = np.searchsorted(h1, g1), np.searchsorted(h1, g1, side="right")
    out = np.zeros(len(g1), bool)
    step = 0
    while len(at := np.flatnonzero(low + step < high)):
        out[at] |= h2[low[at] + step] == g2[at]
        step += 1
    return np.flatnonzero(out)


def _joined(c: W.Chunk, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by single spaces."""
    starts, ends = c.starts[keep], c.ends[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[c.bounds]
    inside = W.cover(starts, ends - starts, len(c.data))
    follows = np.ones(len(ends), bool)  # another kept word of the text, so white space stands behind this one
    follows[bounds[1:][np.diff(bounds) > 0] - 1] = False
    data = c.data.copy()
    data[ends[follows]] = 0x20
    inside[ends[follows]] = True
    raw, sizes = data[inside].tobytes(), np.diff(bounds)
    place = np.concatenate([[0], np.cumsum(inside)])
    begin, end = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    some = sizes > 0
    begin[some], end[some] = place[starts[bounds[:-1][some]]], place[ends[bounds[1:][some] - 1]]
    return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _apply(window: int, with_text: bool):
    """n_words, n_removed and the kept words of documents with their repeated windows (or all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            first, second, whole = batch.column("h1"), batch.column("h2"), batch.column("whole").to_pylist()
            n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
            for c in W.chunks(batch.column("text"), W.NON_SPACE_BYTES):
                sizes = np.diff(c.bounds)
                n_words[c.first : c.first + len(sizes)] = sizes
                h = other = None
                gone = np.zeros(len(c.starts), bool)
                for i, (a, b) in enumerate(zip(c.bounds[:-1], c.bounds[1:], strict=True)):
                    row = c.first + i
                    if whole[row] and b - a >= window:
                        gone[a:b] = True
                    elif b - a >= window and first[row].is_valid and len(first[row]):
                        h = W.word_hashes(c) if h is None else h
                        other = W.word_hashes(c, 1) if other is None else other
                        known = [x[row].values.to_numpy().view(np.uint64) for x in (first, second)]
                        at = _held(W.gram_hashes(h[a:b], window), W.gram_hashes(other[a:b], window, 1), *known)
                        if len(at):
                            gone[a:b] = W.cover(at, window, b - a)
                n_removed[c.first : c.first + len(sizes)] = np.diff(np.concatenate([[0], np.cumsum(gone)])[c.bounds])
                kept[c.first : c.first + len(sizes)] = _joined(c, ~gone)
            columns = [batch.column("doc_id"), pa.array(n_words), pa.array(n_removed)]
            columns.append(pa.array([k.decode() for k in kept]) if with_text else pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"])

    return run


def _of_several(rows: DataFrame, *key: str) -> DataFrame:
    """Each key that several documents hold, and the smallest of them.

    Stored, so that joins to it shuffle both sides and Spark can split a hot key.
    """
    first = rows.groupBy(*key).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    return write_shared(first.select(*key, "least"), "first")[0]


def _copies(docs: DataFrame) -> DataFrame:
    """Ids and hashes (doc, k1, k2) of texts that are equal to that of a smaller id."""
    keys = docs.filter("text <> ''").select("doc", "k1", "k2")
    first = _of_several(keys, "k1", "k2")
    return keys.join(first, ["k1", "k2"]).filter("doc > least").select("doc", "k1", "k2").distinct()


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 or, ``with_text``, the kept words (``kept``)."""
    own: Column = F.col(f"`{doc_id}`")
    base = docs.select(own.alias("doc_id"), F.coalesce(own.cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    copies, _ = write_shared(_copies(base), "copies")
    never, maybe = maybe_in(base.select("doc", "text", "k1", "k2"), copies.select("doc"))
    single = never.select("doc", "text").union(maybe.join(copies, ["doc", "k1", "k2"], "left_anti").select("doc", "text"))
    named = map_batches(single, _names(window, rounds), "name long, doc long, sure boolean", bounded=False)
    spread = named.filter("sure").groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    shared, shared_path = write_shared(spread.filter("least < most").select("name"), "names")
    touched = named.join(shared.withColumn("found", F.lit(True)), "name", "left").filter("found or not sure")
    touched, touched_path = write_shared(touched.groupBy("doc").agg(F.collect_list("name").alias("names")), "touched")
    drop_shared(docs.sparkSession, shared_path)
    _, near = maybe_in(single, touched.select("doc"))
    windows, windows_path = write_shared(map_batches(near.join(touched, "doc").select("doc", "text", "names"), _candidates(window, rounds), "h1 long, h2 long, doc long", bounded=False), "windows")
    drop_shared(docs.sparkSession, touched_path)
    first = _of_several(windows, "h1", "h2")
    repeated, _ = write_shared(windows.join(first, ["h1", "h2"]).filter("doc > least").groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("p")).select("doc", F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2")), "repeated")
    drop_shared(docs.sparkSession, windows_path)
    clean, hit = maybe_in(base, repeated.select("doc").union(copies.select("doc")))
    clean = clean.select("doc_id", "text", F.lit(None).cast("array<long>").alias("h1"), F.lit(None).cast("array<long>").alias("h2"), F.lit(False).alias("whole"))
    hit = hit.join(copies.withColumn("whole", F.lit(True)), ["doc", "k1", "k2"], "left").join(repeated, "doc", "left")
    hit = hit.select("doc_id", "text", "h1", "h2", F.coalesce("whole", F.lit(False)).alias("whole"))
    kind = dict(base.dtypes)["doc_id"]
    return map_batches(clean.union(hit), _apply(window, with_text), f"doc_id {kind}, n_words long, n_removed long, {'kept' if with_text else 'kept_sha256'} string", bounded=False)
