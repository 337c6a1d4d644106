"""Centroid clustering (k-means over integers) with exponion search.

Vectors are quantised, packed into blocks, and written once, bucketed by block.  A round
joins each block to its state (assigned centroid, upper and lower bound of every vector)
without a shuffle, moves the bounds by what the centroids moved, and writes the new state
with the block's sums; Spark adds the sums up, and k rows go to the driver.

A vector is left alone if its upper bound is below its lower bound, or below half the gap
between its centroid and the next one.  If not, its distance is computed, and if that
doesn't settle it, the centroids inside a ball around its own one are scanned, of radius
twice the distance plus the gap: the ball holds the two nearest centroids.  Each centroid
has the others in a list sorted by distance, so a ball is the head of a list.  The radius
is inclusive and bounds are rounded to the safe side, so that ties are always scanned and
go to the smaller number; distances that decide are exact integers.

A vector takes part if it has exactly ``dim`` components, none of them null or not finite;
other rows are left out.  Every row is a vector of its own, whether ids repeat or are
null.  Starting centroids are the vectors with the smallest hashes of their ids (ties: by
components; null ids last).  Fewer vectors than k give as many centroids; none give no
rows.  A centroid without vectors stays where it is.  Quantised components must be within
2^27, so that squared distances fit into 64 bits; the job fails where one isn't.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_shared, new_shared_path, write_shared
from .workers import map_batches

K, ROUNDS, SEED, SCALE, DIM = 8, 10, 3, 1024, 64
#: The largest quantised component: a squared distance of 256 components then still fits into 64 bits.
LARGEST = 1 << 27
#: Relative rounding of bounds, far above what double arithmetic loses in any number of rounds that is run.
SLACK = 1e-9
NEVER = np.iinfo(np.int64).max


@dataclass
class Centroids:
    """The centroids of a round, what they moved since the last one, and the lists that balls are read from."""

    points: np.ndarray
    moved: np.ndarray
    others_moved: np.ndarray
    gap: np.ndarray
    order: np.ndarray
    away: np.ndarray


def centroids_of(points: np.ndarray, before: np.ndarray | None) -> Centroids:
    k = len(points)
    moved = np.sqrt(((points - (points if before is None else before)) ** 2).sum(axis=1).astype(float))
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
    away = np.sqrt(np.array([((points - p) ** 2).sum(axis=1) for p in points], float).reshape(k, k))
    away[np.arange(k), np.arange(k)] = -1.0  # itself first, also among equal ones
    order = np.argsort(away, axis=1, kind="stable")
    away = np.maximum(np.take_along_axis(away, order, axis=1), 0.0)
    gap = away[:, 1] if k > 1 else np.full(k, np.inf)
    return Centroids(points, moved * (1 + SLACK), others * (1 + SLACK), gap, order, away)


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((vectors - points) ** 2).sum(axis=1)


def assign(vectors: np.ndarray, state: tuple | None, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid, upper and lower bound of each vector; and how many distances were computed."""
    n, k = len(vectors), len(c.points)
    if state is None:
        near, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
        rows, counts, computed = np.arange(n), np.full(n, k), 0
    else:
        near, upper, lower = (x.copy() for x in state)
        upper += c.moved[near]
        lower = np.maximum(lower - c.others_moved[near], 0.0)
        settled = lambda at: upper[at] < np.maximum(lower[at], c.gap[near[at]] / 2 * (1 - SLACK))
        rows = np.flatnonzero(~settled(slice(None)))
        upper[rows] = np.sqrt(squared(vectors[rows], c.points[near[rows]])) * (1 + SLACK)
        computed = len(rows)
        rows = rows[~settled(rows)]
        radius = (2 * upper[rows] + c.gap[near[rows]]) * (1 + SLACK)
        counts = np.empty(len(rows), np.int64)
        for j in np.unique(near[rows]):
            of_j = near[rows] == j
            counts[of_j] = np.searchsorted(c.away[j], radius[of_j], side="right")
    best, second, number = np.full(len(rows), NEVER), np.full(len(rows), NEVER), np.full(len(rows), k)
    for rank in range(int(counts.max(initial=0))):
        at = np.flatnonzero(counts > rank)
        j = c.order[near[rows[at]], rank]
        d = squared(vectors[rows[at]], c.points[j])
        computed += len(at)
        wins = (d < best[at]) | ((d == best[at]) & (j < number[at]))
        second[at] = np.where(wins, best[at], np.minimum(second[at], d))
        best[at] = np.where(wins, d, best[at])
        number[at] = np.where(wins, j, number[at])
    near[rows] = number
    upper[rows] = np.sqrt(best.astype(float)) * (1 + SLACK)
    lower[rows] = np.where(second == NEVER, np.inf, np.sqrt(second.astype(float)) * (1 - SLACK))
    return near, upper, lower, computed


def _packed(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            if np.abs(values, dtype=np.int64).max(initial=0) > LARGEST or (values == np.iinfo(np.int64).min).any():
                raise ValueError(f"a quantised component is beyond {LARGEST}")
            ids = batch.column("id")
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([one, pa.array([values.astype(np.int32).tobytes()])], names=["ids", "vectors"])

    return run


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, tuple | None]]:
    """Place in the batch, vectors and state of each block."""
    for i in range(batch.num_rows):
        vectors = np.frombuffer(batch.column("vectors")[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
        raw, n = batch.column("state")[i].as_py(), len(vectors)
        state = None
        if raw is not None:
            state = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.float64, n, 4 * n), np.frombuffer(raw, np.float64, n, 12 * n)
        yield i, vectors, state


def _round(c: Centroids, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The new state of each block, and its sums: for each centroid the number of vectors and their components' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, sums, computed = [], [], []
            for _, vectors, state in _unpacked(batch, dim):
                near, upper, lower, done = assign(vectors, state, c)
                states.append(near.astype(np.int32).tobytes() + upper.tobytes() + lower.tobytes())
                computed.append(done)
                each = [vectors[near == j] for j in range(len(c.points))]
                sums.append([x for e in each for x in (len(e), *e.sum(axis=0).tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(states, pa.binary()), pa.array(sums, pa.list_(pa.int64())), pa.array(computed, pa.int64())], names=["block", "state", "sums", "computed"])

    return run


def _last(c: Centroids, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, vectors, state in _unpacked(batch, dim):
                near, *_ = assign(vectors, state, c)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(near, pa.int32()), pa.array(squared(vectors, c.points[near]))], names=["id", "cluster", "distance"])

    return run


class _Bucketed:
    """A table in the shared folder that is bucketed by block, known to the session under a name of its own."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name, self.path = df.sparkSession, f"dwellspark_{uuid.uuid4().hex}", new_shared_path(df.sparkSession, "blocks")
        df.write.format("parquet").option("path", self.path).bucketBy(buckets, "block").saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_shared(self.spark, self.path)


def quantised(vector: Column, scale: int, dim: int) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(vector) == dim) & finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


@dataclass
class Clustering:
    """rows: id, cluster, distance (squared) of each vector; centroids in order; distances computed in each round."""

    rows: DataFrame
    centroids: list[list[int]]
    computed: list[int]


def k_means(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dim: int = DIM, id_column: str = "vec_id", vector: str = "embedding") -> Clustering:
    """Cluster ``vectors`` in ``rounds`` rounds, and assign them once more."""
    spark: SparkSession = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_column}`").alias("id"), quantised(F.col(f"`{vector}`"), scale, dim).alias("q")).filter("q is not null")
    first = own.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    points = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
    id_type = own.schema["id"].dataType.simpleString()
    if not first:
        return Clustering(spark.createDataFrame([], f"id {id_type}, cluster int, distance long"), [], [])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _Bucketed(map_batches(own, _packed(dim), f"ids array<{id_type}>, vectors binary").withColumn("block", F.monotonically_increasing_id()).repartition(buckets, "block"), buckets)
    before, state, computed = None, None, []
    joined = lambda: blocks.table.join(state.table.select("block", "state").hint("shuffle_hash"), "block") if state else blocks.table.withColumn("state", F.lit(None).cast("binary"))
    for _ in range(rounds):
        c = centroids_of(points, before)
        after = _Bucketed(map_batches(joined().select("block", "vectors", "state"), _round(c, dim), "block long, state binary, sums array<long>, computed long"), buckets)
        if state:
            state.drop()
        state = after
        computed.append(state.table.agg(F.sum("computed")).first()[0])
        totals = state.table.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        flat = {r["at"]: int(r["x"]) for r in totals}
        before, points = points, points.copy()
        for j in range(len(points)):
            if n := flat[j * (dim + 1)]:
                points[j] = [flat[j * (dim + 1) + 1 + i] // n for i in range(dim)]
    rows, _ = write_shared(map_batches(joined().select("ids", "vectors", "state"), _last(centroids_of(points, before), dim), f"id {id_type}, cluster int, distance long"), "clusters")
    if state:
        state.drop()
    blocks.drop()
    return Clustering(rows, points.tolist(), computed)


def report(found: Clustering) -> DataFrame:
    """The rows with the sums of distances (of the cluster, of all) and a hash of the final centroid."""
    spark = found.rows.sparkSession
    hashes = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    names = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = sums.agg(F.sum("own").alias("total"))
    # both sides have a row for each centroid at most
    known = sums.join(names, "cluster").crossJoin(total)
    return found.rows.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", F.col("own").cast("long").alias("cluster_inertia"), F.col("total").cast("long").alias("inertia"), "centroid_sha256")
