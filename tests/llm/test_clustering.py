"""Clustering against plain k-means over all centroids, with integers."""

import hashlib

import numpy as np
import pytest

from dwellspark.llm import clustering
from dwellspark.llm.clustering import assign, centroids_of, k_means, report

from .conftest import clashing


def plain(rows, k, rounds, scale, dim, seed=3):
    """Clusters, distances and centroids, every vector held against every centroid."""
    own = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(own, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in own]
        centroids = [[sum(x) // len(x) for x in zip(*(v for (_, v), j in zip(own, of, strict=True) if j == c), strict=True)] if c in of else old for c, old in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in own), key=repr), centroids


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)


def groups(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, dim))
    return [(i, (centres[rng.integers(9)] + rng.normal(0, 0.2, dim)).tolist()) for i in range(n)]


def grid(seed, n, dim):
    """Few places, so that distances tie and vectors repeat."""
    rng = np.random.default_rng(seed)
    return [(i % 50, (rng.integers(-1, 2, dim) / 4).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [groups(1, 300, 6), grid(2, 300, 6), [(1, [0.5] * 6)] * 40, groups(4, 5, 6)], ids=["groups", "ties", "one place", "few"])
def test_equal_to_plain_rounds(spark, rows):
    odd = [(900, None), (901, [0.1] * 5), (902, [0.1] * 7), (903, [None] + [0.1] * 5), (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, []), (None, [0.25] * 6)]
    found = k_means(clashing(table(spark, rows + odd)), k=8, rounds=4, scale=16, dim=6)
    want, centroids = plain(rows + odd, 8, 4, 16, 6)
    assert found.centroids == centroids
    assert sorted((tuple(r) for r in found.rows.collect()), key=repr) == want
    got = report(found).collect()
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("spread", [2, 40, 4000])
def test_rounds_of_search(spread):
    rng = np.random.default_rng(spread)
    vectors = rng.integers(-spread, spread, (500, 3))
    points, before, state = vectors[:20].copy(), None, None
    work = 0
    for _ in range(12):
        c = centroids_of(points, before)
        near, upper, lower, computed = assign(vectors, state, c)
        state, work = (near, upper, lower), work + computed
        d = ((vectors[:, None] - points) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all()
        own = d[np.arange(500), near]
        others = np.where(np.arange(20) == near[:, None], np.iinfo(np.int64).max, d).min(axis=1)
        assert (upper >= np.sqrt(own)).all() and (lower <= np.sqrt(others)).all()
        before, points = points, np.array([vectors[near == j].sum(axis=0) // (near == j).sum() if (near == j).any() else points[j] for j in range(20)])
    assert spread == 2 or work < 0.6 * 12 * 500 * 20


def test_no_vectors_and_large_ones(spark):
    empty = k_means(table(spark, [(1, None)]), dim=2)
    assert empty.rows.count() == 0 and report(empty).columns[0] == "id" and report(empty).count() == 0
    large = [(i, [2.0**15 * (i % 3), -(2.0**16)]) for i in range(9)]
    found = k_means(table(spark, large), k=2, rounds=2, dim=2)
    assert sorted(tuple(r) for r in found.rows.collect()) == plain(large, 2, 2, 1024, 2)[0]
    with pytest.raises(Exception, match="beyond"):
        k_means(table(spark, [(1, [1e9, 0.0])]), dim=2)


def test_blocks_and_state_meet_without_a_shuffle(spark, monkeypatch):
    plans = []
    write = clustering._Bucketed.__init__
    monkeypatch.setattr(clustering._Bucketed, "__init__", lambda self, df, n: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, n))[1])
    k_means(table(spark, groups(5, 60, 4)), k=3, rounds=3, dim=4)
    assert len(plans) == 4 and all("Exchange" not in p for p in plans[1:]) and "ShuffledHashJoin" in plans[2]
