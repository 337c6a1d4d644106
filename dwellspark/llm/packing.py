"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Planning looks at counts, not documents: a histogram of piece lengths (at most
``capacity`` rows) goes to the driver, which runs best-fit decreasing over it.  Bins
that are alike stay one group, so that a step places one length into a whole group;
a length splits at most two groups, and a group holds at most sqrt(2 * capacity)
distinct lengths, which bounds the plan (below 400,000 rows for 2048) whatever the
input.  Each plan row gives the slots of a range of ranks of one length.  Pieces are
ranked within their length and take the slot of their rank.

A third of all pieces may have one length: ranks are made within (length, salt) and
shifted by the counts of lower salts, so no task holds a whole length.

Null and empty texts are documents of one token, the end id.  Repeated rows are
packed once each.  An empty table gives an empty result.  Extra columns don't take
part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_shared
from .tokens import default_tokenizer, worker_tokenizer
from .workers import map_batches

CAPACITY = 2048
END_ID = 0
#: Pieces (on average) of a length and salt, and the least number of salts.
SALT_ROWS = 100_000
LEAST_SALTS = 128

#: length, first rank, one past the last rank, pieces in each bin, first bin, offset in the bin
PlanRow = tuple[int, int, int, int, int, int]


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[PlanRow]:
    """Slots for all pieces, by best-fit decreasing over counts of lengths."""
    rows: list[PlanRow] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: groups (first bin, bins)
    rooms: list[int] = []
    bins = 0

    def leave(left: int, first: int, n: int) -> None:
        if left <= 0 or n <= 0:
            return
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, n = capacity, bins, -(-count // (capacity // length))
                bins += n
            each = min(left // length, count)
            used = min(n, count // each)
            rows.append((length, rank, rank + each * used, each, first, capacity - left))
            leave(left, first + used, n - used)
            leave(left - each * length, first, used)
            rank, count = rank + each * used, count - each * used
    return rows


def document_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and ids (array) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for chunk in encoder.encode(batch.column(1), end_id):
                sizes = np.diff(chunk.bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw = memoryview(chunk.ids.astype("<u4").tobytes())
                low = (chunk.bounds[row] + start) * 4
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(low.tolist(), (length * 4).tolist(), strict=True)]
                columns = [keys.take(pa.array(row + chunk.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    at = low // 4
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1]).astype(np.int32)), pa.array(chunk.ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(texts, run, schema)


def _take_slots(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            low, high = np.searchsorted(plan[:, 0], length), np.searchsorted(plan[:, 0], length, side="right")
            while (wide := high - low > 1).any():  # a plan's rows of a length are in order of rank
                mid = (low + high) // 2
                up = wide & (plan[np.minimum(mid, len(plan) - 1), 1] <= rank)
                low, high = np.where(up, mid, low), np.where(wide & ~up, mid, high)
            _, begin, _, each, first, offset = plan[low].T
            bin_, place = np.divmod(rank - begin, each)
            kept = [k for k in range(batch.num_columns) if batch.schema.names[k] not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(first + bin_), pa.array(offset + place * length)],
                names=[*(batch.schema.names[k] for k in kept), "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (which must be cheap to read twice) with sequence_id and offset.

    Needs a column ``length`` of 1 to ``capacity``; rows equal in ``keys`` are told apart by nothing else,
    so they may swap places.
    """
    spark = pieces.sparkSession
    salts = max(LEAST_SALTS, pieces.count() // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = np.array(sorted(plan_best_fit(histogram, capacity)), np.int64).reshape(-1, 6)
    lower = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy(*keys)
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("place") + F.col("base")).alias("rank"))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return map_batches(ranked, _take_slots(spark.sparkContext.broadcast(plan)), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its place."""
    pieces, _ = write_shared(document_pieces(docs, tokenizer or default_tokenizer(), capacity=capacity, end_id=end_id, doc_id=doc_id, text=text), "pieces")
    return pack(pieces, capacity=capacity)


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of int), doc_ids and offsets of their pieces in order."""
    pieces, _ = write_shared(document_pieces(docs, tokenizer or default_tokenizer(), capacity=capacity, end_id=end_id, doc_id=doc_id, text=text, with_ids=True), "pieces")
    placed = pack(pieces, capacity=capacity)
    each = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(each.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
