"""Connected components as alternating star joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_shared, write_shared
from .workers import map_batches

#: Edges of a share of which a task keeps a forest.
SHARE = 1 << 15


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def spanning_forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Numbers of links that join what all links join (of places 0 to n - 1), without circles."""
    root = np.arange(n)
    kept: list[np.ndarray] = []
    while True:
        a, b = root[left], root[right]
        between = np.flatnonzero(a != b)
        if not len(between):
            return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        first = np.full(n, len(left))  # each component's first link to another
        np.minimum.at(first, a[between], between)
        np.minimum.at(first, b[between], between)
        chosen = np.unique(first[first < len(left)])
        kept.append(chosen)
        for _ in range(64):  # the chosen links' components get their smallest root
            low = np.minimum(root[left[chosen]], root[right[chosen]])
            before = root.copy()
            np.minimum.at(root, before[left[chosen]], low)
            np.minimum.at(root, before[right[chosen]], low)
            root = root[root]
            if (root == before).all():
                break


def _forests(share: int):
    """A spanning forest of every ``share`` edges that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest() -> pa.RecordBatch:
            edges = pa.Table.from_batches(held).combine_chunks()
            ends = [edges.column(k).to_numpy() for k in ("a", "b")]
            nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
            keep = spanning_forest(place[: len(edges)], place[len(edges) :], len(nodes))
            return edges.take(pa.array(keep)).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(len(x) for x in held) + len(batch) > 2 * share:
                yield forest()
                held = []
            if len(batch):
                held.append(batch)
        if held:
            yield forest()

    return run


def thinned(edges: DataFrame, *, share: int = SHARE) -> DataFrame:
    """Of ``edges`` (distinct, a < b) fewer ones, which join the same nodes.

    Of every share of a dense graph's edges a spanning forest is enough, which grows with the
    nodes of the share and not with their pairs.  Forests are dealt out to fewer tasks and
    thinned again for as long as that halves them.  Sparse graphs are left as they are, and so
    is what two shares hold.
    """
    spark, old = edges.sparkSession, None
    kinds = ", ".join(f"{k} {kind}" for k, kind in edges.dtypes)
    size, nodes = edges.select(F.count("*"), F.approx_count_distinct("a") + F.approx_count_distinct("b")).first()
    while size > 2 * share and size > 2 * nodes:
        after, path = write_shared(map_batches(edges.repartition(-(-size // share)), _forests(share), kinds), "forests")
        if old:
            drop_shared(spark, old)
        edges, old, before, size = after, path, size, after.count()
        if 2 * size > before:
            break
    return edges


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of ``edges`` (columns a, b of one orderable type).

    Each round, every node's larger neighbours are joined to its smallest neighbour
    (large star), then each node and its smaller neighbours to the smallest of them
    (small star).  Minima are partial aggregates and the joins plain, so a node with
    very many edges is split like any skewed join.  Rounds grow with the logarithm of
    the number of nodes; each is written to the shared folder and the one before deleted.
    Dense graphs are thinned to forests first, as every round joins all edges.
    """
    spark = edges.sparkSession
    edges, path = write_shared(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    edges = thinned(edges)
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")).select("e.a", "e.b").filter("a < b").distinct()
        after, new_path = write_shared(small, "edges")
        new_state = _state(after)
        drop_shared(spark, path)
        edges, path = after, new_path
        if new_state == state:
            break
        state = new_state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
