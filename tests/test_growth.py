"""Work that must not grow faster than the tables, or stay in a few tasks."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from dwellspark.operators import answers, keeping, matching
from dwellspark.plans.listing import listings

from .compare import SF_DIR


def test_listings_are_spread(spark):
    """The table is one small file, which a scan reads in one task."""
    assert listings(spark, SF_DIR).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_chunks_are_no_folders(spark, tmp_path):
    path, df = f"file://{tmp_path}/chunks", spark.range(300)
    keeping.write_chunks(df.filter("id < 150"), path, F.expr("id div 3"))
    keeping.write_chunks(df, path, F.expr("id div 3"))
    assert keeping.read_chunks(spark, path).count() == 300
    assert len([p for p in Path(tmp_path).rglob("*") if p.is_dir()]) < 8


def test_dense_spots_meet_few_rows_each_round(spark, monkeypatch):
    rng = random.Random(8)
    def some(n, p):
        return spark.createDataFrame([(f"{p}{i:03}", 51.5 + rng.random() * 0.0003, -0.1 + rng.random() * 0.0003, rng.choice(["1", "2", "3", None]), rng.choice([0.0, 900.0, 1000.0, 1040.0] + ([None, 5000.0 + i, 8000.0 + 60 * i] if p == "b" else []))) for i in range(n)], "listing_id string, latitude double, longitude double, bedrooms string, price_pcm double")

    a, b = some(150, "a"), some(170, "b")
    pairs = matching.spatial_pairs(a, b, price_limit=50.0).localCheckpoint()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for tries in (2, 5):
        monkeypatch.setattr(matching, "TRIES", tries)
        assert rows(matching.first_matches(a, b, price_limit=50.0)) == rows(matching.first_match(pairs)) != []
        assert rows(matching.unmatched(a, b, price_limit=50.0).select("listing_id")) == rows(matching.without_duplicates(b, pairs).select("listing_id")) != []
    empty = a.limit(0)
    assert matching.first_matches(empty, b).count() == matching.first_matches(a, empty).count() == 0 and matching.unmatched(empty, b).count() == 170


def test_blocks_of_vectors(spark, monkeypatch):
    """Several blocks a side, ties, nulls, other lengths, as pairs scored one by one give them."""
    rng = random.Random(4)
    vector = lambda i: None if i % 31 == 5 else [float(rng.randint(-2, 2)) if i % 3 else rng.randint(-9, 9) / 8 for _ in range(3 if i % 17 == 3 else 4)] + ([None] if i % 29 == 7 else [])
    rows = [(i, vector(i), [f"t{i % 6}", "u"][: i % 3]) for i in range(200)]
    queries = [(i, vector(i), [[f"t{i % 6}"], None, ["u", "t1"], ["none"]][i % 4]) for i in range(60)]
    monkeypatch.setattr(answers, "BLOCK", 16)
    found = answers.filtered_vector_top(spark.createDataFrame(queries, "query long, vector array<double>, tokens array<string>"), spark.createDataFrame(rows, "key long, vector array<double>, tokens array<string>"), 9)
    want = []
    for q, v, tokens in queries:
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True)) if v and w and None not in v + w and len(v) == len(w) else None  # noqa: B023, E731
        held = sorted(((s is None, -(s or 0.0), k, s) for k, w, t in rows if not tokens or set(tokens) & set(t) for s in [score(w)]))
        want += [(q, i + 1, k, s) for i, (*_, k, s) in enumerate(held[:9])]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
