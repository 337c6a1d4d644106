"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits meet in the middle: some
variant lies within half the radius of both.  A full ball of the larger half (two
flipped bits) has 2081 variants; dropping a block first makes both halves one bit.
The 64 bits are cut into three blocks.  If three bits at most differ, the block with
the most differing bits has at least a third of them, so in the other two blocks two
at most differ, and each fingerprint emits for each dropped block all variants within
one bit of what is kept: 131 variants.  They are shuffled on, runs of equal variants
are deduplicated, and colliding pairs verified on all 64 bits.  Of a variant's verified
pairs a spanning forest is kept, which joins what they join and grows with its members.

A variant that more than ``RUN`` fingerprints share isn't paired.  Its fingerprints
emit full balls (2081 variants, each with its distance).  All members within two bits
of a variant are within three of any member within one bit: the variant's members are
linked to the smallest of the inner ones, which loses no link and grows with the
members, not with their square.

Documents with equal fingerprints are one node; only distinct fingerprints are hashed.

Null, empty and blank texts have fingerprint zero and are linked like any other.
Null ids never name a component (unless all its ids are null).  Repeated rows get a
row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import wordhash as W
from .components import connected_components, spanning_forest
from .idset import maybe_in
from .shared import Packed, write_shared
from .workers import map_batches

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members of a variant up to which they are paired.
RUN = 32
#: The blocks' first bits, and the end.
BLOCKS = (0, 21, 42, 64)

U64 = np.uint64
ONE_BIT = U64(1) << np.arange(64, dtype=U64)


def shingle_spans(chunk: W.Chunk, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' words joined by single spaces; begin and end of every shingle in that; each text's number of shingles.

    A text of fewer than n words (but some) is one shingle.
    """
    inside = W.cover(chunk.starts, chunk.ends - chunk.starts, len(chunk.data)) if len(chunk.starts) else np.zeros(len(chunk.data), bool)
    follows = np.ones(len(chunk.ends), bool)
    sizes = np.diff(chunk.bounds)
    follows[chunk.bounds[1:][sizes > 0] - 1] = False
    data = chunk.data.copy()
    gaps = chunk.ends[follows]
    data[gaps] = 0x20
    inside[gaps] = True
    place = np.cumsum(inside) - 1
    begin, end = place[chunk.starts], place[chunk.ends - 1] + 1
    count = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    first = np.repeat(chunk.bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = np.minimum(first + n - 1, np.repeat(chunk.bounds[1:] - 1, count))
    return data[inside].tobytes(), begin[first], end[last], count


def majority(hashes: np.ndarray, count: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of texts from the hashes of their features, laid end to end."""
    out = np.zeros(len(count), U64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    at = (np.cumsum(count) - count)[some]
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    if weight is None:
        ones, all_ = np.add.reduceat(bits, at, axis=0, dtype=np.int32), count[some]
    else:
        ones, all_ = np.add.reduceat(bits * weight[:, None], at, axis=0), np.add.reduceat(weight, at)
    out[some] = np.packbits(2 * ones > all_[:, None], axis=1).view(">u8").reshape(-1)
    return out


def shingle_fingerprints(docs: DataFrame, *, n: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long) over every n-word shingle, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, U64)
            for c in W.chunks(batch.column(1), W.NON_SPACE_BYTES, lower=True):
                words, begin, end, count = shingle_spans(c, n)
                hashes = np.fromiter((h(words[a:b], seed) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), U64, len(begin))
                out[c.first : c.first + len(count)] = majority(hashes, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[doc_id]
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(texts, run, f"doc_id {kind}, fp long")


@cache
def block_flips(dropped: int) -> tuple[np.uint64, np.ndarray]:
    """What is kept without a block, and all flips of at most one bit of it, marked with the block's number."""
    own = np.zeros((), U64)
    for b in range(BLOCKS[dropped], BLOCKS[dropped + 1]):
        own |= ONE_BIT[b]
    kept = ~own
    flips = np.concatenate([np.zeros(1, U64), ONE_BIT[(ONE_BIT & kept) != 0]])
    return kept, flips | (U64(dropped) << U64(BLOCKS[dropped]))


@cache
def ball() -> tuple[np.ndarray, np.ndarray]:
    """All flips of at most two bits, and which are of at most one."""
    i, j = np.triu_indices(64, 1)
    return np.concatenate([np.zeros(1, U64), ONE_BIT, ONE_BIT[i] | ONE_BIT[j]]), np.arange(1 + 64 + len(i)) <= 64


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(U64)
        for i in range(0, len(fps), 1024):
            some = fps[i : i + 1024]
            for k in range(3):
                kept, flips = block_flips(k)
                keys = ((some & kept)[:, None] ^ flips[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["key", "fp"])


def _emit_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips, inner = ball()
    for batch in batches:
        fps = batch.column(0).to_numpy().view(U64)
        for i in range(0, len(fps), 64):
            some = fps[i : i + 64]
            keys = (some[:, None] ^ flips[None, :]).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(~inner, len(some))), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["key", "outer", "fp"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by the first, cut only between runs of equal keys."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
        if len(held) > 1 and held[0][0][0] != held[-1][0][0]:
            last = held.pop()
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [last]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0) if len(left) else np.zeros((0, 2), np.int64)


def _collide(radius: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A spanning forest (a < b) of the verified pairs of each variant's fingerprints; (fp, null) for those of a variant with more than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _runs(batches):
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            run_of = np.repeat(np.arange(len(start)), size)
            left = np.repeat(start + size, size) - np.arange(len(key)) - 1  # members after this one
            small = size[run_of] <= most
            found = [np.zeros((2, 0), np.int64)]
            at = np.flatnonzero(small & (left > 0))
            step = 1
            while len(at):
                near = np.bitwise_count((fp[at] ^ fp[at + step]).view(U64)) <= radius
                found.append(np.stack([at[near], at[near] + step]))
                step += 1
                at = at[left[at] >= step]
            links = np.concatenate(found, axis=1)
            links = links[:, np.lexsort((links[1], links[0]))]
            links = links[:, spanning_forest(links[0], links[1], len(key))]
            links = links[:, fp[links[0]] != fp[links[1]]]
            pairs = _pairs(fp[links[0]], fp[links[1]])
            hot = np.unique(fp[~small])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pairs[:, 0], hot])), pa.array(np.concatenate([pairs[:, 1], hot]), mask=np.arange(len(pairs) + len(hot)) >= len(pairs))], names=["a", "b"]
            )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links every member of a variant's ball to its smallest inner member."""
    for key, outer, fp in _runs(batches):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        head = start[run_of]  # inner members come first, ascending
        keep = ~outer[head] & (fp != fp[head])
        pairs = _pairs(fp[keep], fp[head][keep])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def fingerprint_links(fingerprints: DataFrame, *, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """Pairs a < b of the distinct fingerprints (column fp) whose components are those of all pairs within ``radius``.

    Every pair listed is within three bits (within ``radius``, outside of crowded variants, which need 3).
    """
    if radius != RADIUS:
        raise ValueError("the blocks and balls are for a radius of 3")
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored, _ = write_shared(fingerprints.select("fp"), "prints")
    emitted = map_batches(stored.repartition(parts), _emit_blocks, "key long, fp long")
    hits, _ = write_shared(map_batches(emitted.repartition("key").sortWithinPartitions("key", "fp"), _collide(radius, run), "a long, b long").distinct(), "hits")
    crowded = hits.filter("b is null").select(F.col("a").alias("fp"))
    balls = map_batches(crowded, _emit_balls, "key long, outer boolean, fp long")
    stars = map_batches(balls.repartition("key").sortWithinPartitions("key", "outer", "fp"), _stars, "a long, b long")
    return hits.filter("b is not null").union(stars).distinct()


def simhash_components(docs: DataFrame, *, n: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    own, _ = write_shared(shingle_fingerprints(docs, n=n, seed=seed, doc_id=doc_id, text=text), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius=radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named, _ = write_shared(placed, "nodes")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicate groups: words of a shingle, least Jaccard similarity, fingerprints a text, rounds of representatives, first heads of a shingle.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8
TABLES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB)
NEAR_ROUNDS = 3
HEADS = 256


def word_fingerprints(docs: DataFrame) -> DataFrame:
    """doc, k1, k2 and, for each of TABLES, a fingerprint over the words, weighted by the root of their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros((len(TABLES), batch.num_rows), U64)
            n = np.zeros(batch.num_rows, np.int64)
            for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True):
                h = W.word_hashes(c)
                text = W.owner(c.bounds, np.arange(len(h)))
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
                weight = np.sqrt(np.diff(np.append(first, len(h)))).astype(np.float32)
                count = np.bincount(text[first], minlength=len(c.bounds) - 1)
                rows = slice(c.first, c.first + len(count))
                n[rows] = np.diff(c.bounds)
                for k, odd in enumerate(TABLES):
                    prints[k, rows] = majority(W.mix(h[first] * U64(odd)), count, weight)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc", "k1", "k2")), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints)], names=["doc", "k1", "k2", "n", *(f"f{k}" for k in range(len(TABLES)))]
            )

    kind = dict(docs.dtypes)["doc"]
    keyed = docs.select("doc", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    return map_batches(keyed, run, f"doc {kind}, k1 long, k2 long, n long, " + ", ".join(f"f{k} long" for k in range(len(TABLES))))


def _shingle_sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's distinct shingles (a shorter text is one shingle), as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for c in W.chunks(batch.column("text"), W.ALNUM_BYTES, lower=True):
                h = W.word_hashes(c)
                for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True):
                    sets.append(np.unique(W.gram_hashes(h[a:b], min(n, b - a))).tobytes() if b > a else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sets, pa.binary())], names=["doc", "shingles"])

    return run


def _similar(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                both = int(W.member(x, y).sum())
                out.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "similar"])

    return run


def _judged(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b and whether their shingles are similar."""
    of_a = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b")
    return write_shared(map_batches(both, _similar(similarity), "a long, b long, similar boolean"), "judged")[0]


def _roots(edges: DataFrame) -> DataFrame:
    return write_shared(connected_components(edges), "roots")[0]


def _hub_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node (a) with the hub of its component (b): the node of most edges, of several the smallest."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    best = roots.join(degree, "node").groupBy("root").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("b"))
    hubs, _ = write_shared(best, "hubs")
    return roots.join(hubs, "root").filter("node <> b").select(F.col("node").alias("a"), "b")


def _explode_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, its number of shingles, and each of them."""
    for batch in batches:
        for doc, packed in zip(batch.column("doc").to_pylist(), batch.column("shingles"), strict=True):
            own = np.frombuffer(packed.as_buffer(), np.int64)
            for i in range(0, len(own), 1 << 16):
                some = own[i : i + (1 << 16)]
                same = (pa.array(np.full(len(some), x, np.int64)) for x in (doc, len(own)))
                yield pa.RecordBatch.from_arrays([*same, pa.array(some)], names=["doc", "size", "key"])


def _rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """doc, size, key, rank: of each text the rare shingles, of which two similar texts share one.

    If two texts are similar, they share at least ``similarity`` of the shingles of
    either.  Of what they share, take the rarest (of equally rare ones the smallest):
    in each text it has so many others behind it, counted from the most frequent one.
    So only shingles of such a rank are kept, and none that a single text holds.
    """
    every = map_batches(sets, _explode_shingles, "doc long, size long, key long")
    often = every.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = every.join(often, "key").withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("often"), F.desc("key"))))
    return ranked.filter(F.col("rank") >= F.ceil(F.col("size") * similarity - 1e-9)).select("doc", "size", "key", F.col("rank").cast("long").alias("rank"))


def _cross(heads: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a < b) of a shingle's texts of different roots that may be similar, one of them among its first ``heads``.

    Two texts are similar if they share ``similarity`` / (1 + ``similarity``) of the sum
    of their numbers of shingles, so for some shingle both have so high a rank.  Texts of
    small roots come first.  A row of nulls says that pairs are left.
    """
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            pairs = _pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        more = False
        for key, doc, root, length, rank in _runs(batches):

            def like(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return (root[x] != root[y]) & (np.minimum(rank[x], rank[y]) >= share * (length[x] + length[y]) - 1e-9)  # noqa: B023

            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            mixed = np.minimum.reduceat(root, start) < np.maximum.reduceat(root, start)
            left = np.repeat(start + size, size) - np.arange(len(key)) - 1  # members after this one
            at = np.flatnonzero(np.repeat(mixed & (size <= heads), size) & (left > 0))
            found, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 1
            while len(at):
                both = like(at, at + step)
                found.append((doc[at[both]], doc[at[both] + step]))
                step += 1
                at = at[left[at] >= step]
            yield packed()
            crowded = mixed & (size > heads)
            for first, n in zip(start[crowded].tolist(), size[crowded].tolist(), strict=True):
                own = slice(first, first + n)
                _, place, count = np.unique(root[own], return_inverse=True, return_counts=True)
                order = first + np.lexsort((doc[own], place, count[place]))
                more |= bool((root[order[heads:]] != root[order[-1]]).any())
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for i in range(heads):
                    after = order[i + 1 :]
                    after = after[like(order[i], after)]
                    found.append((np.full(len(after), doc[order[i]]), doc[after]))
                    if sum(len(x) for x, _ in found) > 1 << 18:
                        yield packed()
                        found = found[:1]
                yield packed()
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=["a", "b"])

    return run


def _judge_open(candidates: DataFrame, linked: DataFrame, sets: DataFrame, similarity: float, ties: DataFrame | None = None) -> DataFrame:
    """``linked`` and further similar pairs, so that no similar pair of candidates lies between two components.

    Texts of candidates' components that aren't all linked meet under their rare
    shingles: copies edited from one text have near fingerprints, but most of them share
    no shingle of the ranks that similar texts need.  Each round holds the heads of every shingle against its texts of
    other components.  There are four times as many heads in the next round, until none
    has pairs left.
    """
    ties = _roots(candidates) if ties is None else ties
    joined = _roots(linked)
    placed, _ = write_shared(ties.withColumnRenamed("root", "tie").join(joined, "node", "left").select("node", "tie", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("tie").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    open_ = placed.join(mixed, "tie", "left_semi").select(F.col("node").alias("doc"))
    rare, _ = write_shared(_rare_shingles(sets.join(open_, "doc", "left_semi"), similarity), "rare")
    heads, unlike = HEADS, None
    while True:
        own = rare.join(joined.select(F.col("node").alias("doc"), "root"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"), "size", "rank")
        between = own.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
        cells = own.join(between, "key", "left_semi").repartition("key").sortWithinPartitions("key")
        pairs, _ = write_shared(map_batches(cells, _cross(heads, similarity), "a long, b long").distinct(), "pairs")
        new = pairs.filter("a is not null")
        judged = _judged(new if unlike is None else new.join(unlike, ["a", "b"], "left_anti"), sets, similarity)
        linked = linked.union(judged.filter("similar").select("a", "b"))
        if pairs.filter("a is null").isEmpty():
            return linked
        joined = _roots(linked)
        old = judged.filter("not similar").select("a", "b")
        unlike = old if unlike is None else unlike.union(old)
        heads *= 4


def near_duplicate_ids(docs: DataFrame, *, n: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY, rounds: int = NEAR_ROUNDS) -> DataFrame:
    """Ids (column doc) of ``docs`` (doc, text) that are copies or near copies of a document that stays.

    Candidates are texts within three bits in one of the fingerprints over their words,
    which near copies share far more often than fingerprints over shingles.  Within each
    component of candidates all texts are held against the hub, which is mostly the text
    that the others were made from; two texts whose n-word shingles have at least
    ``similarity`` are linked.  What isn't linked forms components anew, ``rounds``
    times.  Then all texts of candidates' components that aren't wholly linked are joined
    on their rare shingles, and pairs between components of links judged, until none is
    open.  Of every component of links the smallest id stays.
    """
    prints, _ = write_shared(word_fingerprints(docs), "prints")
    nodes, _ = write_shared(prints.groupBy("k1", "k2").agg(F.min("doc").alias("id"), F.min("n").alias("n"), *(F.min(f"f{k}").alias(f"f{k}") for k in range(len(TABLES)))), "nodes")
    # fingerprints of all tables together: those of different tables have nothing in common, and all pairs are judged
    own = nodes.filter("n > 0").select("id", F.explode(F.array(*(f"f{k}" for k in range(len(TABLES))))).alias("fp"))
    least, _ = write_shared(own.groupBy("fp").agg(F.min("id").alias("least")), "least")
    links, _ = write_shared(fingerprint_links(least.select("fp")), "links")
    equal = own.join(least, "fp").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges = equal.union(near).filter("a <> b")
    edges, _ = write_shared(edges.distinct(), "candidates")
    members = edges.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    _, maybe = maybe_in(docs, members)
    sets, _ = write_shared(map_batches(maybe.join(members, "doc").select("doc", "text"), _shingle_sets(n), "doc long, shingles binary").dropDuplicates(["doc"]), "shingles")
    ties = _roots(edges)
    linked, left = None, edges
    for k in range(rounds):
        judged = _judged(_hub_pairs(left, _roots(left) if k else ties), sets, similarity)
        found = judged.filter("similar").select("a", "b")
        linked = found if linked is None else linked.union(found)
        open_ = judged.filter("not similar").select(F.col("a").alias("node"))
        left = left.join(open_.withColumnRenamed("node", "a"), "a", "left_semi").join(open_.withColumnRenamed("node", "b"), "b", "left_semi")
        left, _ = write_shared(left.select("a", "b"), "candidates")
        if left.isEmpty():
            break
    linked = _judge_open(edges, linked, sets, similarity, ties)
    near = connected_components(linked).filter("node <> root").select(F.col("node").alias("doc"))
    gone = prints.join(nodes.select("k1", "k2", "id"), ["k1", "k2"]).filter("doc <> id").select("doc")
    return gone.union(near).distinct()


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of copies and near copies.

    Null texts are empty ones.  Rows that share an id stay or go together, as the
    smallest id of their group does; rows without an id stay.  Ids of any type that has an
    order will do.  All columns are kept, also where names differ in case alone.
    """
    packed = Packed(docs)
    named = packed.field(doc_id)
    if isinstance(docs.schema[packed.index(doc_id)].dataType, IntegralType):
        rows = packed.rows.withColumn("doc", named.cast("long"))
    else:  # other ids are numbered in their order
        ids = packed.rows.select(named.alias("id")).filter("id is not null").distinct()
        numbers, _ = write_shared(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("doc", F.monotonically_increasing_id()), "ids")
        rows, _ = write_shared(packed.rows.withColumn("id", named).join(numbers, "id", "left").drop("id"), "numbered")
    body = F.coalesce(packed.field(text).cast("string"), F.lit(""))
    own = rows.select("doc", body.alias("text")).filter("doc is not null")
    gone, _ = write_shared(near_duplicate_ids(own, **options), "gone")
    marked = rows.select("row", F.coalesce("doc", F.lit(-1)).alias("doc"), F.col("doc").isNull().alias("nameless"))
    never, maybe = maybe_in(marked, gone)
    kept = maybe.filter("not nameless").join(gone, "doc", "left_anti").select("row").union(maybe.filter("nameless").select("row"))
    return packed.unpack(never.select("row").union(kept))
