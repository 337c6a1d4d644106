"""Evidence, structured lookup, filtered searches, stage counts and kept tables against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.functions import fixed as X
from dwellspark.operators import answers, keeping


def test_filtered_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)], [f"t{i % 5}", "all"] if i % 7 else []) for i in range(120)] + [(500, [1.0, 0.0, 0.0, 0.0], None)]
    queries = [(i, [float(x) for x in rng.integers(-3, 4, 4)], t) for i, t in enumerate([["t1"], ["t2", "t3"], [], None, ["nowhere"], ["all", "t1"], ["t1", "t1"]])]
    got = answers.filtered_vector_top(spark.createDataFrame(queries, "query long, vector array<double>, tokens array<string>"), spark.createDataFrame(rows, "key long, vector array<double>, tokens array<string>"), 4).collect()
    want = []
    for q, v, tokens in queries:
        held = [(-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w, t in rows if not tokens or set(tokens) & set(t or [])]
        want += [(q, rank + 1, k, -s) for rank, (s, k) in enumerate(sorted(held)[:4])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_evidence_falls_back_for_each_listing(spark):
    sims = {"school": 0.3, "general": 0.2}
    rows = [
        (1, "schools", 0, "Good school near", sims), (1, "schools", 1, "Good school near", {"school": 0.9}), (1, "features", 2, "Lift", sims), (1, "description", 3, "A school run", {"school": 0.95}),
        (2, "stations", 0, "Oval school", sims), (2, "notes", 1, "school", {"school": 1.0}), (3, "notes", 0, "school", sims), (4, "stations", 0, "Bank", {}),
    ]
    df = spark.createDataFrame(rows, "id int, field string, place int, text string, sims map<string,double>")
    got = {(r["id"], r["category"], r["rank"], r["place"], r["score"]) for r in answers.evidence(df, {"school": ["school"], "transit": []}, key="id").collect()}
    assert got == {(1, "school", 1, 0, 1.0), (1, "school", 2, 3, 1.0), (2, "general", 1, 0, 1.0), (4, "general", 1, 0, 0.0)}


def test_fields_that_terms_name(spark):
    schema = "k int, price_pcm double, rooms struct<beds:int,more:struct<baths:string>>, stations string, description string, tags array<string>"
    records = spark.createDataFrame([(1, 900.0, (2, ("1",)), "Oval | Bank", "text", ["a", "b"]), (2, None, (None, ("unknown",)), "", "text", [])], schema)
    asked = spark.createDataFrame([("q1", 1, ["Prices", "Station"]), ("q2", 1, ["number of baths!"]), ("q3", 2, ["price", "bed", "baths"]), ("q4", 9, ["price"]), ("q5", 1, ["description", "zzz", ""]), ("q6", 1, ["tags"]), ("q7", 1, None)], "question string, k int, terms array<string>")
    got = {(r["question"], r["field"], r["item"]) for r in answers.structured_lookup(asked, records, key="k").collect()}
    assert got == {("q1", "price_pcm", "900.0"), ("q1", "stations", "Oval"), ("q1", "stations", "Bank"), ("q6", "tags", "a"), ("q6", "tags", "b")}
    assert answers.paths(records.schema)[2:4] == [("`rooms`.`beds`", "rooms_beds"), ("`rooms`.`more`.`baths`", "rooms_more_baths")]
    words = spark.createDataFrame([("Prices",), ("gas",), ("EPC ratings",), ("bus",), (None,)], "t string")
    assert [r[0] for r in words.select(answers.singular(F.col("t"))).collect()] == ["price", "gas", "epcrating", "bus", ""]
    assert "description" in X.UNSTRUCTURED_FIELDS


def test_chunks_are_written_once_and_torn_ones_again(spark, tmp_path):
    path, df = f"file://{tmp_path}/chunks", spark.range(100).withColumn("v", F.col("id") * 2)
    by = F.expr("id div 10")
    assert keeping.write_chunks(df.filter("id < 30"), path, by).count() == 3
    # a run that ends between rows and manifest: chunk 5 is there in part, and nothing names it
    df.filter("id between 50 and 54").withColumn("chunk", F.lit(5)).write.mode("append").partitionBy("chunk").parquet(f"{path}/rows")
    assert keeping.read_chunks(spark, path).count() == 30
    # finished chunks are not even looked at
    wrong = df.withColumn("v", F.when(F.col("id") < 30, -1).otherwise(F.col("v")))
    manifest = keeping.write_chunks(wrong, path, by)
    assert sorted(tuple(r) for r in manifest.collect()) == [(c, 10) for c in range(10)]
    rows = keeping.read_chunks(spark, path).collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [(i, 2 * i) for i in range(100)]
    assert keeping.write_chunks(df, path, by).count() == 10 and keeping.write_chunks(df.limit(0), f"{path}-none", by).count() == 0


def test_texts_are_embedded_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    embed = lambda said: F.array(F.length(said).cast("double"))
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id int, text string")
    first, n = keeping.embedded_once(df, path, embed)
    assert n == 3 and {(r["id"], r["vector"][0]) for r in first.collect()} == {(1, 1.0), (2, 2.0), (3, 1.0), (4, 0.0), (5, 0.0)}
    assert keeping.embedded_once(df, path, embed)[1] == 0
    assert keeping.embedded_once(df.union(spark.createDataFrame([(6, "ccc")])), path, embed)[1] == 1
    keeping.expire(spark, path, df.filter("id < 3"))
    assert spark.read.parquet(path).count() == 2 and keeping.embedded_once(df, path, embed)[1] == 1


@pytest.mark.parametrize("least", [0, 1000])
def test_stages_are_counted_while_a_plan_runs_once(spark, least):
    stages = keeping.Stages()
    some = stages.count(spark.range(1000).repartition(3).filter(F.col("id") % 3 == 0).filter(F.col("id") >= least), "some")
    stages.count(some.orderBy(F.desc("id")).limit(7), "best").write.format("noop").mode("overwrite").save()
    assert stages.counts() == ({"some": 334, "best": 7} if least == 0 else {"some": 0, "best": 0})


def test_preferences_are_found_under_either_key(spark):
    from dwellspark.operators import preference

    records = spark.createDataFrame([(1, "u1", "a"), (2, None, "b"), (3, "ask agent", "c"), (4, "u1", "z"), (5, "u5", "none")], "record long, url string, listing_id string")
    rows = [(r, f, p, v) for r, f, p, v in [(1, "features", 0, [1.0, 0.0]), (2, "features", 0, [0.0, 1.0]), (2, "features", 1, [1.0, 0.0]), (2, "features", 2, [-1.0, 0.0]), (2, "description", 3, [0.0, -1.0]), (3, "description", 0, [0.0, 1.0]), (4, "features", 0, [0.6, 0.8]), (4, "other", 1, [9.0, 9.0])]]
    segments = spark.createDataFrame(rows, "record long, field string, place int, vector array<double>")
    listings = spark.createDataFrame([("a", "u1"), ("b", None), ("b2", "nowhere"), ("c", ""), ("none", "u5"), ("", None)], "listing_id string, url string")
    got = {r["listing_id"]: r for r in preference.preference_scores(listings, records, segments, {"x": [1.0, 0.0], "y": [0.0, -1.0]}).collect()}
    assert sorted(got) == ["a", "b", "c"]
    # of two records under one URL the last counts
    assert got["a"]["preference_score"] == pytest.approx((0.8 + 0.1) / 2) and got["a"]["hits"] == ["x"]
    x, y = (0.8 * (0.7 * 1.0 + 0.3 * 0.5) + 0.6 * 0.5) / 1.4, (0.8 * (0.7 * 0.5 + 0.3 * 0.5) + 0.6 * 1.0) / 1.4
    assert got["b"]["preference_score"] == pytest.approx((x + y) / 2) and got["b"]["hits"] == ["x", "y"]
    assert [(e["intent"], e["field"], e["place"]) for e in got["b"]["evidence"]] == [("x", "description", 3), ("x", "features", 1), ("x", "features", 0), ("y", "description", 3), ("y", "features", 1), ("y", "features", 2)]
    assert got["c"]["preference_score"] == pytest.approx((0.5 + 0.0) / 2)
    scored = preference.with_preference(listings, preference.preference_scores(listings, records, segments, {"x": [1.0, 0.0]}), F.lit(0.25)).collect()
    assert {r["listing_id"]: r["preference_score"] for r in scored}["b2"] == 0.25
    assert {r["preference_score"] for r in preference.preference_scores(listings, records, segments, {}).collect()} == {0.0}
