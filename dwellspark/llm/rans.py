"""A compact file format for token ids: static range asymmetric numeral system (rANS).

A dataset is a folder with four Parquet tables:

``frequencies``  symbol, frequency: one table for all blocks; frequencies sum to
                 2**SCALE_BITS and every symbol of the corpus has one.
``blocks``       one row a block: ``file`` and ``block`` (its order), ``first`` (ids of
                 the file before it), ``n`` (ids), ``payload`` (32-bit words), ``crc32``
                 (of payload and checkpoints), ``checkpoints``, and the documents (or
                 parts of one) in it: ``doc_ids``, ``sizes``.
``files``        file, n: ids of each file.  Files are ranges of ascending doc_id.
``split``        documents longer than a block, which several blocks share.

A block's ids are dealt to LANES coders in turn; every LANES ids are a step.  The
coders share one payload: at each step those that need it take the next words, lanes
ascending.  Every STEPS_PER_CHECKPOINT steps the states of all lanes and the place in
the payload are kept, so that a decoder starts at any checkpoint, and one block's
stretches are decoded side by side.  Blocks need nothing from each other.

Blocks begin at documents.  A document longer than BLOCK_IDS has blocks of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_shared, new_shared_path
from .tokens import default_tokenizer, worker_tokenizer
from .workers import map_batches

END_ID = 1
SCALE_BITS = 20
LANES = 512
STEPS_PER_CHECKPOINT = 64
BLOCK_IDS = 1 << 17
#: Ids (about) of a file.
FILE_IDS = 1 << 23
#: The most files, beyond which they grow; bounds the broadcast of their sizes.
MOST_FILES = 1 << 20
#: Lower bound of a coder's state.
LOW = np.uint64(1 << 31)
U64 = np.uint64

BLOCKS = "file int, block int, first long, n long, payload binary, checkpoints binary, crc32 long, doc_ids array<{kind}>, sizes array<long>, part int"


def scaled_frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs."""
    total, target = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    if int((counts > 0).sum()) > target:
        raise ValueError(f"more symbols than 2**{bits}")
    exact = counts * (target / total)
    out = np.where(counts > 0, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
    order = np.argsort(-(exact - out), kind="stable")
    while (missing := target - int(out.sum())) > 0:
        out[order[out[order] > 0][:missing]] += 1
    while (excess := int(out.sum()) - target) > 0:
        large = np.argsort(-out, kind="stable")
        large = large[out[large] > 1][: max(1, min(excess, len(large) // 8))]
        out[large[:excess]] -= 1
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(U64)
        self.start = np.concatenate([[0], np.cumsum(frequencies)])[:-1].astype(U64)
        self.limit = self.frequency << U64(63 - SCALE_BITS)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints of a block."""
        n = len(ids)
        steps = -(-n // LANES)
        grid = np.zeros(steps * LANES, np.int64)
        grid[:n] = ids
        grid = grid.reshape(steps, LANES)
        f, c, most = self.frequency[grid], self.start[grid], self.limit[grid]
        words = np.zeros((steps, LANES), np.uint32)
        wrote = np.zeros((steps, LANES), bool)
        state = np.full(LANES, LOW, U64)
        kept = []
        for t in range(steps - 1, -1, -1):
            live = LANES if t < steps - 1 else n - t * LANES
            x, ft = state[:live], f[t, :live]
            out = x >= most[t, :live]
            words[t, :live] = x.astype(np.uint32)
            wrote[t, :live] = out
            x = np.where(out, x >> U64(32), x)
            q = x // ft
            state[:live] = (q << U64(SCALE_BITS)) + (x - q * ft) + c[t, :live]
            if t % STEPS_PER_CHECKPOINT == 0:
                kept.append(state.copy())
        sums = np.concatenate([[0], np.cumsum(wrote.sum(axis=1))])
        places = sums[np.arange(0, steps, STEPS_PER_CHECKPOINT)].astype(U64)
        table = np.column_stack([places, np.array(kept[::-1], U64).reshape(-1, LANES)]) if steps else np.zeros((0, LANES + 1), U64)
        return words[wrote].astype("<u4").tobytes(), table.astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ids of a block; all stretches between checkpoints at once."""
        if not n:
            return np.zeros(0, np.uint32)
        words = np.append(np.frombuffer(payload, "<u4"), np.uint32(0)).astype(U64)
        table = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)
        place, state = table[:, 0].astype(np.int64), table[:, 1:].astype(U64)
        stretches = len(table)
        out = np.zeros((stretches, STEPS_PER_CHECKPOINT, LANES), np.uint32)
        lane = np.arange(LANES)
        first = np.arange(stretches) * STEPS_PER_CHECKPOINT * LANES
        mask = U64((1 << SCALE_BITS) - 1)
        whole = n // LANES  # full steps of the block
        for t in range(STEPS_PER_CHECKPOINT):
            here = np.flatnonzero(first + t * LANES < n)
            if not len(here):
                break
            x = state[here]
            slot = x & mask
            s = self.symbol[slot]
            x = self.frequency[s] * (x >> U64(SCALE_BITS)) + slot - self.start[s]
            need = x < LOW
            if here[-1] * STEPS_PER_CHECKPOINT + t >= whole:  # the last step may not be full
                live = first[here[-1]] + t * LANES + lane < n
                x[-1] = np.where(live, x[-1], state[here[-1]])
                need[-1] &= live
            at = place[here][:, None] + np.cumsum(need, axis=1) - 1
            x = np.where(need, (x << U64(32)) | words[np.where(need, at, 0)], x)
            place[here] += need.sum(axis=1)
            state[here] = x
            out[here, t] = s
        return out.reshape(-1)[:n]


def token_table(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n and ids (little-endian bytes of the vocabulary's width) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer)
        for batch in batches:
            for chunk in encoder.encode(batch.column(1), end_id):
                width = chunk.ids.dtype.itemsize
                raw = chunk.ids.tobytes()
                at = (chunk.bounds * width).tolist()
                n = np.diff(chunk.bounds)
                ids = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(n)), pa.array(n), pa.array(np.full(len(n), width, np.int32)), ids], names=["doc_id", "n", "width", "ids"])

    kind = dict(docs.dtypes)[doc_id]
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(texts, run, f"doc_id {kind}, n long, width int, ids binary", bounded=False)


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids"), strict=True):
            own = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
    symbols = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(counts[symbols])], names=["symbol", "count"])


def _encode_blocks(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of one file, from its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        file, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids_of: list = []
        kind = None

        def flush(parts: list[np.ndarray], docs: list, part: int) -> pa.RecordBatch:
            nonlocal block, first
            ids = np.concatenate(parts)
            payload, checkpoints = coder.encode(ids)
            crc = zlib.crc32(checkpoints, zlib.crc32(payload))
            row = {"file": [file], "block": [block], "first": [first], "n": [len(ids)], "payload": [payload], "checkpoints": [checkpoints], "crc32": [crc], "doc_ids": [docs], "sizes": [[len(p) for p in parts]], "part": [part]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.int32()]
            block, first = block + 1, first + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        size = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, width, raw in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                if held and size + len(ids) > BLOCK_IDS:
                    yield flush(held, ids_of, -1)
                    held, ids_of, size = [], [], 0
                if len(ids) > BLOCK_IDS:
                    for k, a in enumerate(range(0, len(ids), BLOCK_IDS)):
                        yield flush([ids[a : a + BLOCK_IDS]], [doc], k)
                    continue
                held.append(ids)
                ids_of.append(doc)
                size += len(ids)
        if held:
            yield flush(held, ids_of, -1)

    return run


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Write ``tokens`` (as of ``token_table``; read three times, so give a stored one) in ascending doc_id order."""
    spark = tokens.sparkSession
    counts = map_batches(tokens, _count_symbols, "symbol long, count long", bounded=False).groupBy("symbol").agg(F.sum("count").alias("count"))
    rows = counts.collect()  # at most the vocabulary
    table = np.zeros(max([r["symbol"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        table[r["symbol"]] = r["count"]
    frequencies = scaled_frequencies(table)
    spark.createDataFrame([(int(i), int(frequencies[i])) for i in np.flatnonzero(frequencies)], "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    files = max(1, min(MOST_FILES, int(table.sum()) // FILE_IDS))
    kind = dict(tokens.dtypes)["doc_id"]
    # by length and content too, so that very many rows of one id, or of none, don't fall to one file
    ordered = tokens.withColumn("content", F.xxhash64("ids")).repartitionByRange(files, "doc_id", "n", "content").sortWithinPartitions("doc_id", "n", "content")
    map_batches(ordered.select("doc_id", "width", "ids"), _encode_blocks(spark.sparkContext.broadcast(frequencies)), BLOCKS.format(kind=kind), bounded=False).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _read_blocks(shared, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if zlib.crc32(r["checkpoints"], zlib.crc32(r["payload"])) != r["crc32"]:
                    raise ValueError(f"file {r['file']}, block {r['block']}: wrong checksum")
                ids = coder.decode(r["payload"], r["checkpoints"], r["n"]).astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.cumsum(r["sizes"])
                starts = ends - r["sizes"]
                m = len(ends)
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(r["base"] + r["first"] + starts),
                    pa.array(np.array(r["sizes"], np.int64)),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(np.full(m, r["part"], np.int32)),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "part"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_of_joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes that lie end to end, from each part's crc32 and number of bytes."""
    total = 0
    for crc, size in parts:
        shift = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
        for _ in range(3):
            shift = [_times(shift, x) for x in shift]  # one zero byte
        while size:
            if size & 1:
                total = _times(shift, total)
            shift = [_times(shift, x) for x in shift]
            size >>= 1
        total ^= crc
    return total


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False, only: str = "true") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part of each document or part of one, and ids (array of int) if asked for.

    ``only``: a condition on blocks, of which others aren't decoded.
    """
    rows = spark.read.parquet(f"{path}/frequencies").collect()  # at most the vocabulary
    frequencies = np.zeros(max([r["symbol"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        frequencies[r["symbol"]] = r["frequency"]
    blocks = spark.read.parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, part int" + (", ids array<int>" if with_ids else "")
    parts = map_batches(blocks.filter(only).join(F.broadcast(base), "file"), _read_blocks(spark.sparkContext.broadcast(frequencies), with_ids), schema, bounded=False)
    return parts


def documents_of(parts: DataFrame) -> DataFrame:
    """One row a document: parts of documents that several blocks share are joined."""
    return parts.filter("part < 0").drop("part").unionByName(_joined(parts.filter("part >= 0")))


def read_documents(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """The same from the files; each block is decoded once."""
    whole = read_tokens(spark, path, with_ids=with_ids, only="part < 0").drop("part")
    return whole.unionByName(_joined(read_tokens(spark, path, with_ids=with_ids, only="part >= 0")))


def _joined(parts: DataFrame) -> DataFrame:
    names = parts.columns
    crc = F.udf(lambda x: crc32_of_joined([(p["ids_crc32"], 4 * p["n_tokens"]) for p in x]), "long")
    first = F.col("start") - F.col("part") * F.lit(BLOCK_IDS)
    split = parts.groupBy("doc_id", first.alias("start")).agg(F.array_sort(F.collect_list(F.struct("part", *(c for c in names if c not in ("doc_id", "part", "start"))))).alias("p"))
    return split.select("doc_id", "start", F.aggregate("p.n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), crc("p").alias("ids_crc32"), *([F.flatten("p.ids").alias("ids")] if "ids" in names else []))


def encode_corpus(docs: DataFrame, tokenizer: str | None = None, *, path: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> str:
    """Tokenize ``docs`` and write them in this format; returns the folder.

    Null and empty texts are documents of the end id alone; rows with equal ids stay, next to each other.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer or default_tokenizer(), end_id=end_id, doc_id=doc_id, text=text)
    stored = new_shared_path(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(stored)
    path = path or new_shared_path(spark, "rans")
    write_tokens(spark.read.schema(tokens.schema).parquet(stored), path)
    drop_shared(spark, stored)
    return path
