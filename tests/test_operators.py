"""Operators over listings, on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from dwellspark.operators import filters, matching, ranking, sensitivity, sync
from dwellspark.operators.constraints import Constraints, Layout, ResultCache
from dwellspark.sources import files
from dwellspark.streaming.ingest import read_table, upsert_batch


def test_constraint_algebra():
    c = Constraints(max_rent=3500.0, layouts=(Layout(bedrooms=1, bathrooms=1.0),), furnish_type="furnished", locations=("Waterloo",))
    assert c.merged({"max_rent": 3000.0, "let_type": None}).max_rent == 3000.0
    assert c.merged({"max_rent": 3000.0}).furnish_type == "furnished"
    assert c.derived({"furnish_type": "unfurnished"}, clear=("furnish_type",)).furnish_type == "", "clearing wins"
    assert c.derived({"max_rent": 1.0}, reset=True).locations == ()
    assert c.merged({"locations": ("oval",)}, append_locations=True).locations == ("waterloo", "oval")
    assert c.merged({"layouts": (Layout(bedrooms=2, max_rent=2000.0),)}).max_rent == 2000.0
    three = Constraints(layouts=(Layout(bedrooms=2, bathrooms=1.0), Layout(bedrooms=2), Layout(tag="studio", property_type="flat")))
    assert three.merged({}, remove_layouts=(Layout(bedrooms=2),)).layouts == (Layout(tag="studio", property_type="flat"),)
    assert three.merged({"layouts": (Layout(bedrooms=3),)}, append_layouts=True, remove_layouts=(Layout(bathrooms=1.0), Layout(property_type="flat"))).layouts == (Layout(bedrooms=2), Layout(bedrooms=3))
    a = Constraints(layouts=(Layout(bedrooms=1), Layout(bedrooms=2)), max_rent=2000, k=5)
    b = Constraints(layouts=(Layout(bedrooms=2), Layout(bedrooms=1)), max_rent=2000.0, k=9)
    assert a.hash() == b.hash() != c.hash()
    assert c.cheaper().max_rent == pytest.approx(2975.0) and c.cheaper(0.1).max_rent == 1750.0
    assert c.relaxed("max_rent", 1, c).max_rent == 4375.0 and c.relaxed("furnish_type", 0, c).furnish_type == ""
    dated = Constraints(available_from="2024-02-20", min_size_sqm=41.0)
    assert dated.relaxed("available_from", 0, dated).available_from == "2024-03-05" and dated.relaxed("min_size_sqm", 0, dated).min_size_sqm == 36.9
    assert Constraints(available_from="soon").relaxed("available_from", 0, dated).available_from is None
    assert set(c.changes(c.cheaper())) == {"max_rent"}


def test_cache_keeps_the_latest(spark):
    cache = ResultCache(2)
    cs = [Constraints(max_rent=float(i)) for i in range(3)]
    for c in cs[:2]:
        cache.put(c, spark.range(1))
    assert cache.get(cs[0]) is not None
    cache.put(cs[2], spark.range(1))
    assert cache.get(cs[1]) is None and cache.get(cs[0]) is not None


COLUMNS = "k int, property_type string, price_pcm string, bedrooms string, bathrooms string, furnish_type string, let_type string, available_from string, min_tenancy string, size_sqm string, size_sqft string, pets_allowed boolean, features string, description string"


def listing(k, **values):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return tuple({"k": k, **values}.get(n) for n in names)


def test_unknown_passes_and_known_fails(spark):
    rows = [
        listing(1),
        listing(2, property_type="Parking space"),
        listing(3, price_pcm="2001"),
        listing(4, price_pcm="ask agent", furnish_type="Ask agent", available_from="someday"),
        listing(5, furnish_type="unfurnished", let_type="Short-term"),
        listing(6, available_from="now", min_tenancy="12 months"),
        listing(7, available_from="02/03/2024", size_sqft="400 sq ft"),
        listing(8, description="Sorry, no pets"),
        listing(9, pets_allowed=True, description="no pets"),
    ]
    c = Constraints(max_rent=2000.0, furnish_type="Furnished", let_type="long term", available_from="2024-02-01", min_tenancy_months=6, min_size_sqm=40.0, bool_preferences={"pets_allowed": True})
    audited = {r["k"]: list(r["reasons"]) for r in filters.audit(spark.createDataFrame(rows, COLUMNS), c, "2024-01-01").collect()}
    assert audited == {1: [], 3: ["price"], 4: [], 5: ["furnish_type", "let_type"], 6: ["min_tenancy"], 7: ["available_from", "size_sqm"], 8: ["bool_pets_allowed"], 9: []}
    assert sorted(r["k"] for r in filters.hard_filter(spark.createDataFrame(rows, COLUMNS), c, "2024-01-01").collect()) == [1, 4, 9]


def test_layouts(spark):
    rows = [listing(1, bedrooms="2", price_pcm="1500"), listing(2, bedrooms="2.5"), listing(3, bedrooms="1"), listing(4, property_type="flat", bedrooms="0"), listing(5, property_type="studio"), listing(6, property_type="house", bedrooms="2", price_pcm="2600")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = lambda *o, rent=None: sorted(r["k"] for r in filters.hard_filter(df, Constraints(max_rent=rent, layouts=o), "2024-01-01").collect())
    assert got(Layout(bedrooms=2), rent=2000.0) == [1, 2, 5]
    assert got(Layout(bedrooms=2, max_rent=1000.0), rent=2000.0) == [2, 5]
    assert got(Layout(tag="studio")) == [4, 5]
    assert got(Layout(bedrooms=1), Layout(property_type="house")) == [1, 2, 3, 5, 6]


def test_match_percent_and_pages(spark):
    df = spark.createDataFrame([listing(1, pets_allowed=True, furnish_type="furnished"), listing(2), listing(3, pets_allowed=False, furnish_type="unfurnished")], COLUMNS)
    c = Constraints(furnish_type="furnished", bool_preferences={"pets_allowed": True})
    assert [r[0] for r in df.orderBy("k").select(ranking.match_pct(c, df.columns, F.lit(0.0), F.lit(0.0))).collect()] == [100, 50, 50]
    pages = lambda p: [(r["id"], r["has_more"]) for r in ranking.page(spark.range(12), [F.asc("id")], p, 5).orderBy("id").collect()]
    assert [i for i, _ in pages(1)] == [5, 6, 7, 8, 9] and pages(1)[0][1]
    assert pages(2) == [(10, False), (11, False)] and pages(3) == []


def test_spatial_pairs_at_cell_edges(spark):
    step = 9.9 / 111_195
    a = spark.createDataFrame([("a1", 51.5, -0.1, 2, 1000.0), ("a2", 51.50009999, -0.1000001, None, None), ("a3", None, None, 1, 1.0)], "listing_id string, latitude double, longitude double, bedrooms int, price_pcm double")
    rows = [("b1", 51.5 + step, -0.1, 2, 1100.0), ("b2", 51.5 + 10.2 / 111_195, -0.1, 2, 1000.0), ("b3", 51.5, -0.1, 3, 1000.0), ("b4", 51.5, -0.1, None, 1101.0), ("b5", 51.5, -0.1, None, None)]
    b = spark.createDataFrame(rows, "listing_id string, latitude double, longitude double, bedrooms int, price_pcm double")
    got = sorted((r["a_key"], r["b_key"]) for r in matching.spatial_pairs(a, b).collect())
    assert [x for x in got if x[0] == "a1"] == [("a1", "b1"), ("a1", "b5")]
    assert ("a2", "b1") in got and ("a2", "b2") in got and not [x for x in got if x[0] == "a3"]


def test_sync(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "old")], "listing_id string, v string")
    new = spark.createDataFrame([("2", "new"), ("3", "new"), ("3", "new"), (None, "x")], "listing_id string, v string")
    assert sorted((r[0], r[1]) for r in sync.incremental_sync(old, new).collect()) == [("2", "old"), ("3", "new")]
    stamps = spark.createDataFrame([("a", "2023"), ("b", "2025"), ("c", None), ("d", "")], "k string, scraped_at string")
    assert sorted(r[0] for r in sync.purge_stale(stamps, "2024").collect()) == ["b", "c", "d"]


def test_decisions():
    assert sensitivity.decide(20, None, 0) == "done"
    assert sensitivity.decide(0, 0, 0) == "ask"
    assert [sensitivity.decide(3, 9, n) for n in (0, 1, 2)] == ["relax", "relax", "done"]
    assert sensitivity.decide(0, 9, 2) == "ask"


def test_compare_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, p int, t string")
    got = {r["field"]: (r["a"], r["b"]) for r in sensitivity.compare_rows(df, "id", ["p", "t"]).collect()}
    assert got == {"p": ("1", "2"), "t": ("x", None)}


def test_files(spark, tmp_path):
    lines = [json.dumps({"listing_id": "a", "price_pcm": 100, "bedrooms": "ask agent"}), "{broken", "", json.dumps({"listing_id": "b", "image_urls": ["x"]})]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    got = files.read_listings(spark, f"file://{tmp_path}/l.jsonl")
    assert [r["listing_id"] for r in got.select("listing_id", "price_pcm").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_listings(spark, f"file://{tmp_path}/l.jsonl", strict=True).collect()
    files.write_listings(got, f"file://{tmp_path}/run_2")
    files.write_listings(got, f"file://{tmp_path}/run_1")
    assert files.latest_run(spark, f"file://{tmp_path}").endswith("run_2")
    (tmp_path / "u.txt").write_text("# c\n http://a \n\nhttp://b")
    assert sorted(r[0] for r in files.read_urls(spark, f"file://{tmp_path}/u.txt").collect()) == ["http://a", "http://b"]


def test_spots_match_as_all_pairs_do(spark):
    import random

    rng = random.Random(6)
    def some(n, p):
        return spark.createDataFrame([(f"{p}{i:03}", 51.5 + rng.randint(0, 6) * 0.00004 if i % 9 else None, -0.1 + rng.randint(0, 4) * 0.00007, rng.choice(["1", "2", None]), rng.choice([900.0, 1000.0, None])) for i in range(n)], "listing_id string, latitude double, longitude double, bedrooms string, price_pcm double")

    a, b = some(60, "a"), some(80, "b")
    pairs = matching.spatial_pairs(a, b, price_limit=50.0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(matching.first_matches(a, b, price_limit=50.0)) == rows(matching.first_match(pairs)) != []
    assert rows(matching.unmatched(a, b, price_limit=50.0).select("listing_id")) == rows(matching.without_duplicates(b, pairs).select("listing_id")) != []


def test_a_batch_that_runs_again_gives_the_same_table(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    sink = upsert_batch(table, "k", ["ts"], "ts > 0", buckets=4)
    batches = [[(k, 5, "a") for k in range(20)] + [(1, 4, "b"), (2, 0, "c")], [(1, 6, "d"), (30, 1, "e")], [], [(1, 5, "late"), (31, 2, "f")], [(1, 9, "g")]]
    known: dict[int, tuple] = {}
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k int, ts int, v string")
        for r in rows:
            if r[1] > 0 and (r[0] not in known or known[r[0]][1] < r[1]):
                known[r[0]] = r
        for _ in range(2):
            sink(df, number)
            assert sorted(map(tuple, read_table(spark, table, number, df.schema).collect())) == sorted(known.values())
    left = [(v.name, b.name) for v in (tmp_path / "t/rows").iterdir() for b in v.iterdir() if b.name.startswith("bucket")]
    assert ("v=0", "bucket") not in left and len(left) <= 4 + 1, "replaced buckets go"
    assert read_table(spark, table, 4, df.schema, "ts > 5").count() == 1
    nothing = upsert_batch(f"{table}-none", "k", ["ts"], "ts > 0")
    nothing(df.limit(0), 0)
    assert read_table(spark, f"{table}-none", 0, df.schema).count() == 0


def test_fallback_to_a_place(spark):
    every = spark.createDataFrame([(1, 51.5, -0.1, 3.0), (2, 51.51, -0.1, 2.0), (3, 52.5, -0.1, 9.0), (4, None, None, 8.0), (5, 51.5, -0.1, 1.0)], "k long, latitude double, longitude double, score double")
    around = lambda found: sorted(r["k"] for r in filters.or_around(found, every, 51.5, -0.1, F.col("score"), 4, "k").collect())
    assert around(every.filter("k = 3")) == [3]
    assert around(every.filter("k > 9")) == [1, 2]


def test_districts(spark):
    df = spark.createDataFrame([(1, "se1"), (2, "SE15"), (3, None), (4, " N1")], "k long, postcode_district string")
    assert sorted(r["k"] for r in filters.in_districts(df, ["SE1 ", "n1"]).collect()) == [1, 4]
    assert filters.in_districts(df, ["", " "]).count() == 4


def test_regions_within(spark):
    df = spark.createDataFrame([(1, 51.5, -0.1), (2, 51.53, -0.1), (3, 55.0, 0.0), (4, None, -0.1)], "k long, latitude double, longitude double")
    got = {r["k"]: (r["near_regions"], r["primary_region"]) for r in matching.regions_within(df, [("north", 51.54, -0.1), ("here", 51.5, -0.1), ("alike", 51.5, -0.1)], 4.0).collect()}
    assert got == {1: (["alike", "here"], "alike"), 2: (["north", "alike", "here"], "north"), 3: ([], None), 4: ([], None)}
    narrow = matching.regions_within(df, [("north", 51.54, -0.1)], 1.0).filter("k = 2").first()
    assert (narrow["near_regions"], narrow["primary_region"]) == ([], "north")


def test_commute_times_repeat_no_listing(spark):
    df = spark.createDataFrame([(1, 51.5001, -0.1), (2, 51.6, -0.2), (3, None, -0.1), (1, 51.5001, -0.1)], "k long, latitude double, longitude double")
    times = spark.createDataFrame([(51.5002, -0.1, 40), (51.4999, -0.1, 25), (51.5, -0.1, None), (None, -0.1, 5)], "latitude double, longitude double, minutes int")
    got = sorted((r["k"], r["commute_minutes"]) for r in matching.with_commute(df, times).collect())
    assert got == [(1, 25), (1, 25), (2, None), (3, None)]


def test_discovery_paths_are_attached(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "key string, n int")
    paths = spark.createDataFrame([("a", ["SE1", "N1"]), ("c", ["W2"])], "key string, discovery_paths array<string>")
    got = sync.with_discovery(df, paths, "key")
    assert {r["n"]: r["discovery_paths"] for r in got.collect()} == {1: ["SE1", "N1"], 2: [], 3: [], 4: ["SE1", "N1"]}
    again = sync.with_discovery(got, paths, "key")
    assert again.columns == ["key", "n", "discovery_paths"]
