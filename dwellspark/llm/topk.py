"""Exact top-k inner products with a bit-sliced index.

The index keeps vectors in blocks of up to ``BLOCK_ROWS`` rows.  A block has, for each
attribute (component), the slices of its quantised values: slice b is the bitmap of
bit b over the rows; negative values are shifted up by a bias first.

A query's scores are sums of slices: for every set bit b of a weight, an attribute's
slices are added b places higher.  All attributes of one sign are added with carry-save
adders over bitmaps, giving the slices of the positive and the negative part; a last
ripple subtracts them.  Rows are then selected from the most significant slice
downward: the rows that can still be among the top k are intersected with each slice,
and rows tied at the boundary are resolved by the smallest id.  Each block gives each
query its k best rows, and these are merged by Spark; nothing is approximate.

Queries come in groups of about ``QUERY_ROWS``.  Every block meets every group: both are
tables, copied under the number of each other's rows and shuffled on the pair of numbers,
so that a task holds one group and takes the blocks that meet it one by one.  Nothing
passes through the driver but counts.

Vectors that are null or hold null or non-finite components take no part.  Shorter
vectors count as padded with zeros.  Rows that share an id are rows of their own: each
is a candidate, and each that is asked for gets its own result.  A query is never its own
candidate, but other rows of its id are.  Quantised components and scores must fit into
64 bits; the job fails where one doesn't, and never gives a wrong one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_shared
from .workers import map_batches

K = 5
SCALE = 256
LONGEST = float(1 << 63)
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 1 << 15

U64 = np.uint64


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for vectors that take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when((y >= -LONGEST) & (y < LONGEST), F.floor(y)).otherwise(F.raise_error(F.lit("a quantised component doesn't fit into 64 bits")).cast("long"))

    return F.when(finite, F.transform(vector, whole))


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps (attribute, bit, word) of a block's values (row, attribute), each attribute shifted to be 0 at least."""
    rows, dims = values.shape
    low = values.min(axis=0) if rows else np.zeros(dims, np.int64)
    up = (values.astype(U64) - np.minimum(low, 0).astype(U64)).T
    bits = int(up.max(initial=0)).bit_length()
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words), U64)
    for b in range(bits):
        packed = np.zeros((dims, words * 8), np.uint8)
        packed[:, : -(-rows // 8)] = np.packbits(((up >> U64(b)) & U64(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, b] = packed.view(U64)
    return out


def exact_scores(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays of long."""
    bound = (np.abs(values.astype(float)) * np.abs(weights.astype(float))).sum(axis=1).max(initial=0)
    if bound < 1 << 62:
        return np.einsum("ij,ij->i", values, weights)
    exact = (values.astype(object) * weights.astype(object)).sum(axis=1)
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise OverflowError("a score doesn't fit into 64 bits")
    return exact.astype(np.int64)


def _add_up(columns: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Slices of the sum of bitmaps, given by their place value; three become two (carry-save) until one is left a place."""
    out = []
    at = 0
    while at < len(columns):
        own = columns[at]
        while len(own) > 2:
            a, b, c = own.pop(), own.pop(), own.pop()
            ab = a ^ b
            own.append(ab ^ c)
            if at + 1 == len(columns):
                columns.append([])
            columns[at + 1].append((a & b) | (ab & c))
        if len(own) == 2:
            a, b = own
            if at + 1 == len(columns):
                columns.append([])
            columns[at + 1].append(a & b)
            out.append(a ^ b)
        else:
            out.append(own[0] if own else np.zeros(width, U64))
        at += 1
    return out


def score_slices(index: np.ndarray, weights: np.ndarray, shift: int) -> list[np.ndarray]:
    """Slices of sum(weight * value) + shift, which is never negative; attributes' values are those of the index.

    A negative weight adds the complement of its attribute's slices: -w * v = |w| * (m - v) - |w| * m for all-ones m.
    """
    dims, bits, width = index.shape
    top = 2 + max(1, int(np.abs(weights).max(initial=1))).bit_length() + bits
    columns: list[list[np.ndarray]] = [[] for _ in range(top)]
    for d in np.flatnonzero(weights).tolist():
        w = abs(int(weights[d]))
        own = index[d] if weights[d] > 0 else ~index[d]
        j = 0
        while w >> j:
            if (w >> j) & 1:
                for b in range(bits):
                    columns[j + b].append(own[b])
            j += 1
    if shift:
        ones = np.full(width, ~U64(0))
        for b in range(shift.bit_length()):
            if (shift >> b) & 1:
                while len(columns) <= b:
                    columns.append([])
                columns[b].append(ones)
    return _add_up(columns, width)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest score among ``allowed``; of tied rows the first."""
    sure, open_ = np.zeros_like(allowed), allowed
    n_sure = 0
    for s in reversed(slices):
        with_bit = open_ & s
        n = _count(with_bit)
        if n_sure + n > k:
            open_ = with_bit
        elif n:
            sure, n_sure, open_ = sure | with_bit, n_sure + n, open_ & ~s
        if n_sure == k:
            return _rows(sure)
    return np.concatenate([_rows(sure), _rows(open_)[: k - n_sure]])


def _blocks(limit: int, index: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's vectors in blocks, by id: their ids, numbers and values (little-endian), and the slices of an index.

    ``number`` tells the blocks apart.
    """

    def block(at: int, ids: np.ndarray, numbers: np.ndarray, vectors: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((numbers, ids))
        dims = max((len(v) for v in vectors), default=0)
        values = np.zeros((len(ids), dims), np.int64)
        for r, i in enumerate(order.tolist()):
            values[r, : len(vectors[i])] = vectors[i]
        slices = slices_of(values) if index else np.zeros((dims, 0, 0), U64)
        width = 4 if not values.size or np.abs(values.astype(float)).max() < 1 << 31 else 8
        number = (TaskContext.get().partitionId() << 32) + at
        row = [[number], [len(ids)], [dims], [width], [slices.shape[1]], [ids[order].astype("<i8").tobytes()], [numbers[order].astype("<i8").tobytes()], [values.astype(f"<i{width}").tobytes()], [slices.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k < 5 else pa.binary()) for k, v in enumerate(row)], names=BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        held = made = 0
        for batch in batches:
            own, number = batch.column("vec_id").to_numpy(), batch.column("number").to_numpy()
            lists = batch.column("v")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            at = at - at[0]
            for i in range(0, len(own), limit):
                some = own[i : i + limit]
                if held + len(some) > limit:
                    yield block(made, np.concatenate(ids), np.concatenate(numbers), vectors)
                    ids, numbers, vectors, held, made = [], [], [], 0, made + 1
                ids.append(some)
                numbers.append(number[i : i + limit])
                vectors += [flat[a:b] for a, b in zip(at[i : i + len(some)], at[i + 1 : i + len(some) + 1], strict=True)]
                held += len(some)
        if held:
            yield block(made, np.concatenate(ids), np.concatenate(numbers), vectors)

    return run


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """A block's sizes, ids, numbers and values."""
    r = {name: batch.column(name)[i].as_py() for name in BLOCK_NAMES}
    values = np.frombuffer(r["vals"], f"<i{r['width']}").reshape(r["rows"], r["dims"]).astype(np.int64)
    return r, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["numbers"], "<i8"), values


def _padded(values: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, max(0, dims - values.shape[1]))))[:, :dims]


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each block's k best rows for every query of the group that it meets.  A group comes before its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                pair = (batch.column("block")[i].as_py(), batch.column("grp")[i].as_py())
                r, ids, numbers, values = _unpacked(batch, i)
                if not batch.column("indexed")[i].as_py():
                    held = (pair, ids, numbers, values)
                    continue
                if held is None or held[0] != pair:
                    continue
                _, query_ids, query_numbers, queries = held
                dims = r["dims"]
                queries = _padded(queries, dims)
                index = np.frombuffer(r["slices"], U64).reshape(dims, r["bits"], -1 if dims and r["bits"] else 0)
                full = np.zeros(-(-len(ids) // 64), U64)
                full.view(np.uint8)[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), bool), bitorder="little")
                place = dict(zip(numbers.tolist(), range(len(numbers)), strict=True))
                best: list[np.ndarray] = []
                for q, weights in zip(query_numbers.tolist(), queries, strict=True):
                    allowed = full
                    at = place.get(q)
                    if at is not None:
                        allowed = full.copy()
                        allowed[at // 64] &= ~(U64(1) << U64(at % 64))
                    slices = score_slices(index, weights, 0) if dims and r["bits"] else []
                    best.append(top_rows(slices, allowed, k))
                rows = np.concatenate(best).astype(np.int64)
                which = np.repeat(np.arange(len(query_ids)), [len(b) for b in best])
                scores = np.concatenate([exact_scores(values[rows[a : a + 8192]], queries[which[a : a + 8192]]) for a in range(0, len(rows), 8192)] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(query_numbers[which]), pa.array(query_ids[which]), pa.array(ids[rows]), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])

    return run


BLOCK_NAMES = ["number", "rows", "dims", "width", "bits", "ids", "numbers", "vals", "slices"]
BLOCK = "number long, rows long, dims long, width long, bits long, ids binary, numbers binary, vals binary, slices binary"


def top_k(vectors: DataFrame, asked: str | Column, *, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each vector for which ``asked`` holds with all others."""
    condition = F.expr(asked) if isinstance(asked, str) else asked
    own = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector}`"), scale).alias("v"), F.coalesce(condition, F.lit(False)).alias("asked"))
    rows, _ = write_shared(own.filter("vec_id is not null and v is not null").withColumn("number", F.monotonically_increasing_id()), "vectors")
    queries = rows.filter("asked")
    groups = max(1, -(-queries.count() // query_rows))
    blocks, _ = write_shared(map_batches(rows.select("vec_id", "number", "v"), _blocks(block_rows, True), BLOCK), "index")
    asked_blocks, _ = write_shared(map_batches(queries.select("vec_id", "number", "v").repartition(groups), _blocks(2 * query_rows, False), BLOCK), "queries")
    numbers = lambda t, name: t.select(F.col("number").alias(name))
    # every pair of numbers is wanted: these are blocks of the stated query set against blocks of all rows
    of_blocks = blocks.crossJoin(F.broadcast(numbers(asked_blocks, "grp"))).withColumn("block", F.col("number")).withColumn("indexed", F.lit(True))
    of_groups = asked_blocks.crossJoin(F.broadcast(numbers(blocks, "block"))).withColumn("grp", F.col("number")).withColumn("indexed", F.lit(False))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = of_blocks.unionByName(of_groups).repartition(parts, "block", "grp").sortWithinPartitions("block", "grp", "indexed")
    found = map_batches(met, _search(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
