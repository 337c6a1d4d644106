"""Blocks of typed texts against blocks of names, as loops over all pairs score them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.functions import fuzzy, near
from dwellspark.operators import places

rng = random.Random(3)


def word(n):
    return "".join(rng.choice("abcdt1") for _ in range(n))


def by_loops(q, name, way):
    if way == near.IN_ORDER:
        return fuzzy.subsequence(q, name)
    like = fuzzy.window_likeness(q, name)
    enough = like >= 1.0 - fuzzy.allowed_edits(max(len(q), min(len(name), len(q) + 1))) / len(q)
    return 0.68 + 0.20 * like + 0.12 * min(len(q), len(name)) / max(len(q), len(name)) if enough and like < 1.0 else 0.0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6, 8, 11, 14, 64, 65])
def test_blocks_lose_nothing(size, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 64)
    monkeypatch.setattr(near, "PLACES", 256)
    asked, found = sorted({word(size) for _ in range(8)}), 0
    for length in [*range(max(1, size - 4), size + 8), size + 20]:
        names = sorted({word(length) for _ in range(9)} | {(word(a) + q[b:] + word(length))[:length] for q in asked for a, b in ((0, 1), (1, 0), (1, 1), (2, 0))} | {(word(length) + q[: size - 1])[-length:] for q in asked[:4]} | {"".join(x + rng.choice(("", "t")) for x in q).ljust(length, "c")[:length] for q in asked})
        for way in (near.WHOLE if length <= size + 2 else near.WINDOWS, *([near.IN_ORDER] if 3 <= size <= 8 and length >= size else [])):
            floors = [rng.choice([0.80, 0.85, 0.90, 0.93]) for _ in asked]
            got = {(q, n): s for q, n, s in near.best_of_blocks("".join(asked), size, np.array(floors), "".join(names), length, way, len(names)) if way == near.IN_ORDER or fuzzy.window_likeness(q, n) < 1.0}
            want = {(q, n): s for q, floor in zip(asked, floors, strict=True) for n in names if (s := by_loops(q, n, way)) >= floor - near.SPARE}
            assert got == want
            found += len(want)
            few = list(near.best_of_blocks("".join(asked), size, np.array(floors), "".join(names), length, way, 2))
            assert all(sum(f[0] == q for f in few) <= 2 for q in asked)
    assert found or size == 1


def test_pairs_do_not_leave_their_blocks(spark, monkeypatch):
    """Many names near every text: as few rows as are asked for leave a block, whatever its pairs."""
    monkeypatch.setattr(places, "NAMES", 50)
    monkeypatch.setattr(places, "TEXTS", 20)
    parts = "the and ing er on an th re ou en".split()
    texts = sorted({"".join(rng.choice(parts) for _ in range(4)) for _ in range(60)})
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(500)} - set(texts))
    typed = spark.createDataFrame([(t,) for t in texts], "typed string")
    held = spark.createDataFrame([(n,) for n in names], "name string").withColumn("first", F.struct(F.length("name").alias("n"), F.col("name").alias("alias")))
    assert places.containment_best(typed, held, 3).groupBy("typed").count().filter("count > 3").count() == 0
    blocks = places._blocks(held.withColumn("floor", F.lit(0.0)), "name", F.col("first"), places.NAMES).select(F.col("size").alias("length"), F.col("block").alias("part"), F.col("texts").alias("names")).localCheckpoint()
    assert blocks.count() > len({len(n) for n in names})
    out = places.block_best(typed.withColumn("floor", F.lit(0.80)), blocks, (near.WHOLE,), 3)
    assert 0 < out.count() <= 3 * len(texts) * blocks.count() and out.groupBy("typed", F.length("name")).count().agg(F.max("count")).first()[0] <= 3 * blocks.count()
    got = {}
    for r in places.near_best(typed, held, n=3, least=0.80).collect():
        got.setdefault(r["typed"], []).append((-r["score"], len(r["name"]), r["name"]))
    want = {t: sorted((-s, len(n), n) for n in names if (s := fuzzy.alias_score(t, n)) >= 0.80)[:3] for t in texts}
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v}


def test_runs_of_letters_are_not_broadcast(spark, monkeypatch):
    """Texts of few bytes give many runs of letters, which the driver must not hold: only numbers of beginnings are broadcast, of which there are SLOTS at most."""
    monkeypatch.setattr(places, "SLOTS", 7, raising=False)
    parts = "the and ing er on an th re ou en a".split()
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)})
    typed = spark.createDataFrame([(t,) for t in texts], "typed string")
    held = spark.createDataFrame([(n,) for n in names], "name string").withColumn("first", F.struct(F.length("name").alias("n"), F.col("name").alias("alias")))
    out = places.containment_best(typed, held, 10_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 == plan.count("BroadcastExchange") and "LeftSemi" in plan
    assert {(r["typed"], r["name"]) for r in out.collect()} == {(t, n) for t in texts for n in names if t in n or n in t}


@pytest.mark.parametrize("n", [1, 3])
def test_floors_rise_as_blocks_go_by(n):
    """A text's best names of many blocks, by all ways, with those that stand equal to the last of them."""
    asked = sorted({word(7) for _ in range(12)})
    texts = near.Asked("".join(asked), 7, np.full(len(asked), 0.80), n)
    names = sorted({word(length) for length in (5, 6, 7, 8, 9, 10, 12, 15) for _ in range(40)} | {q[:3] + "t" + q[3:] + word(k) for q in asked for k in (1, 4)} | {word(3) + q[1:] for q in asked})
    for length in sorted({len(x) for x in names}):
        own = [x for x in names if len(x) == length]
        for a in range(0, len(own), 20):
            texts.meet(near.Names("".join(own[a : a + 20]), length), [w for w in range(3) if texts.likely(length, w)])
    scores = {q: {x: s for x in names if (s := max(by_loops(q, x, near.WHOLE), by_loops(q, x, near.IN_ORDER))) >= 0.80} for q in asked}
    got = {}
    for q, x, s in texts.best():
        if fuzzy.window_likeness(q, x) < 1.0:
            got.setdefault(q, {})[x] = s
    for q in asked:
        least = sorted(scores[q].values())[-n:][0] if scores[q] else 1.0
        want = {x: s for x, s in scores[q].items() if s >= least}
        if any(fuzzy.window_likeness(q, x) == 1.0 for x in names):
            continue
        if len(scores[q]) >= n:
            assert set(got.get(q, {}).items()) <= set(want.items()) and len(got[q]) >= n
        else:
            assert got.get(q, {}) == want
    assert sum(map(len, got.values())) > n
