"""Column functions, one row a rule."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import dates, fixed, fuzzy, geo, requests, signals, text
from dwellspark.sources import pages


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (text.safe_text, {None: "", " x ": "x", "Ask Agent": "", "nan": "", "None": "", "none given": "none given"}),
        (text.to_float, {None: None, "£1,200 pcm": 1200.0, "ask agent": None, "-3.5": -3.5, "1-2": None, "": None}),
        (text.furnishing, {None: "", "Unfurnished": "unfurnished", "Part_Furnished": "part-furnished", "furnished": "furnished", "N/A": "ask agent", "Furnished or unfurnished": "flexible", "landlord flexible": "flexible", "fully furnished": "furnished", "bare": "bare"}),
        (text.property_class, {None: "", "Studio": "flat", "Semi-Detached": "house", "Ask agent": "other", "Maisonette": "flat", "Barn": "other", "yurt": "yurt"}),
        (text.months, {"6 months": 6.0, "1.5 months": 1.5, "ask agent": None, None: None, "long": None}),
        (text.slug, {"King's Cross St. Pancras": "king_s_cross_st_pancras", "--": ""}),
        (text.location_keyword, {"  'King-s'  X ": "king s x"}),
        (text.postcode_district, {"10 Rd, SE1 9AB London": "SE1", "ec1a 1bb": "EC1A", "none": ""}),
        (text.money, {"£1,250 deposit": 1250, "free": None}),
        (text.jsonish_items, {None: [], '[{"name": "A", "miles": 0.3}, {"name": ""}]': ["A (0.3 miles)"], "A | B |": ["A", "B"], '["x", "ask agent"]': ["x"], '{"name": "B"}': ["B"], "one": ["one"], "[]": []}),
        (text.description_chunks, {"First one here. Second! ok\nA third line": ["First one here.", "A third line"], None: []}),
        (dates.day_first, {"2024-03-01": dt.date(2024, 3, 1), "03/04/2026": dt.date(2026, 4, 3), "03/14/2026": dt.date(2026, 3, 14), "1-2-24": dt.date(2024, 2, 1), "31/02/2024": None, "soon": None}),
        (lambda c: dates.age_days(c, "2024-01-15"), {"Added today": 0, "yesterday": 1, "Added on 05/01/2024": 10, "2024-02-01": 0, "?": None, None: None}),
        (signals.coerce_bool, {"Yes": True, "0": False, "maybe": None, None: None}),
        (requests.max_rent_pcm, {"within 5 miles": None, "max 2 bed": None, "within 15 minutes": None, "max 2 bed under 2,600": 2600.0, "under £1,500 for 12 months": 1500.0, "under 2,600": 2600.0, "£300 pw": 1300.0, "2 bed": None, "1900 pcm": 1900.0}),
        (requests.bedrooms, {"2 bed": 2, "1b1b": 1, "studio": 0, "flat": None}),
        (lambda c: requests.parsed(c)["min_tenancy_months"], {"for 6 months": 6.0, "a year": 12.0, "two years": 24.0, "": None}),
        (
            lambda c: F.transform(requests.layout_options(c), lambda x: F.concat_ws("|", x["bedrooms"], x["bathrooms"], x["property_type"], x["layout_tag"], x["max_rent_pcm"])),
            {
                "2 bed under 2600 and 3 bed under 3,400": ["2|2600.0", "3|3400.0"],
                "1b1b/2b1b": ["1|1.0", "2|1.0"],
                "studio or 1 bed under 1500": ["1|1500.0", "flat|studio|1500.0"],
                "2 bed / 1 bath, 2 bed 1 bath": ["2|1.0"],
                "2 bed, 1 bath at most £1500": ["2|1.0|1500.0"],
                "2 bed and 1 bath": ["2", "1.0"],
                "2 bedroom and 2 bathroom flat": ["2|flat", "2.0|flat"],
                "£900 pcm 1 bed house or 3 bed up to 2000": ["1|house|900.0", "3|house|2000.0"],
                "1 bed and " + "x" * 60 + " under 900": ["1"],
                "2 bed £0 pcm, 950 pcm or studio": ["2|950.0", "flat|studio|950.0"],
                "a flat with a garden": ["flat"],
                "": [],
            },
        ),
        (
            lambda c: F.transform(requests.removed_layouts(c), lambda x: F.concat_ws("|", x["bedrooms"], x["layout_tag"], x["max_rent_pcm"])),
            {"drop the 2 bed under 900 and studio": ["2", "studio"], "2 bed": [], "remove it": []},
        ),
        (
            lambda c: F.size(requests.without_layouts(requests.layout_options(c), F.transform(requests.removed_layouts(F.lit("remove 2 bed")), lambda x: x))),
            {"2 bed 1 bath under 900, 3 bed, 2 bed": 1, "studio": 1, "": 0},
        ),
        (
            lambda c: requests.commute_destination(c),
            {"I work at Oxford Circus, under 900": "Oxford Circus", "commuting to Bank and back": "Bank", "Travelling to Old Street daily": "Old Street", "office in x": None, "travel to Oval every day": None, "": None, "my work by King's Cross": "King's Cross"},
        ),
        (
            lambda c: requests.uncovered(F.split(c, ","), F.create_map(F.lit("garden"), F.lit(True), F.lit("pets_allowed"), F.lit(False))),
            {"Garden view,quiet,no pets,parking": ["quiet", "parking"], "petty": ["petty"]},
        ),
        (text.without_note, {"King's Cross St. Pancras (0.3 mi)": "King's Cross St. Pancras", "Oval": "Oval", "(x) Bank": "(x) Bank", "none": ""}),
        (text.feature_list, {'["- Lift", "N/A", " Garden "]': ["Lift", "Garden"], "• Lift; – Porter\nask agent\n- x": ["Lift", "Porter", "x"], "[broken; Lift": ["[broken", "Lift"], "none": [], "": [], None: []}),
        (
            lambda c: requests.available_from(c).cast("string"),
            {"from april 3rd, 2026": "2026-04-03", "3 may 2026": "2026-05-03", "no later than 2026/01/05 or 04/02/2027": "2026-01-05", "starting: 5 sept, 2026": None, "05/02/26 then": "2026-02-05", "by june": None},
        ),
        (lambda c: requests.parsed(c)["mode"], {"start over": "replace_all", "also parking": "append", "flat": "replace"}),
        (lambda c: requests.parsed(c)["clears"], {"any budget and remove the location": ["budget", "location"], "x": []}),
        (lambda c: requests.parsed(c)["bool_preferences"], {"with a dog, non-smoking": {"pets_allowed": True, "smokers_allowed": False}, "": {}}),
        (pages.visible_text, {"<p>A &amp; B</p><script>x<y</script><!-- c --><div>C</div>": "A & B\nC"}),
        (pages.pairs, {"<dl><dt>Let Type</dt><dd><b>Long</b></dd><dt>x</dt> <dd>1</dd></dl>": {"let type": "Long", "x": "1"}}),
        (pages.images, {'<img src="a.jpg"><img src="logo.png"><img src="a.jpg"><img src="b.jpg">': ["a.jpg", "b.jpg"]}),
    ],
)
def test_rules(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_uuid5(spark):
    namespace = uuid.UUID(fixed.UUID_NAMESPACE)
    names = [f"part:{i}" for i in range(40)] + ["", "é"]
    assert values(spark, text.uuid5, names) == [str(uuid.uuid5(namespace, n)) for n in names]


def test_half_even_prices(spark):
    df = spark.createDataFrame([(None, 300), (1000, 300), (None, None), (None, 150)], "pcm int, pw int")
    assert [r[0] for r in df.select(text.monthly_price(F.col("pcm"), F.col("pw"))).collect()] == [1300, 1000, None, 650]


@pytest.mark.parametrize(("a", "b", "n"), [("wtaerloo", "waterloo", 1), ("ca", "abc", 3), ("", "ab", 2), ("kitten", "sitting", 3), ("abcd", "badc", 2)])
def test_edits(a, b, n):
    assert fuzzy.edits(a, b) == n == fuzzy.edits(b, a)


def test_alias_scores():
    assert fuzzy.subsequence("bdg", "bridge") > 0.8 > fuzzy.subsequence("xyz", "bridge")
    assert fuzzy.alias_score("waterlo", "waterloo") > 0.9
    rng = random.Random(1)
    for _ in range(300):
        q, n = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert 0 <= fuzzy.alias_score(q, n) <= 1.0 and fuzzy.window_likeness(q, q) == 1.0


def test_abbreviations(spark):
    df = spark.createDataFrame([("kx", "kx"), ("kings x stn", "kingsxstn"), ("st pancras kings", "stpancraskings"), ("oval", "oval")], "p string, c string")
    assert [r[0] is not None for r in df.select(fuzzy.abbreviation(F.col("p"), F.col("c"))).collect()] == [True, True, True, False]


def test_distances(spark):
    df = spark.createDataFrame([(51.5, -0.1, 51.5, -0.1), (51.5, -0.1, 51.6, -0.1)], "a double, b double, c double, d double")
    km, m = geo.haversine_km(*map(F.col, "abcd")), geo.haversine_m(*map(F.col, "abcd"))
    rows = df.select(km.alias("km"), m.alias("m")).collect()
    assert rows[0]["km"] == 0 and abs(rows[1]["km"] - 11.1195) < 1e-3 and abs(rows[1]["m"] - 1000 * rows[1]["km"]) < 1e-6


def test_flags_and_phrases(spark):
    rows = [(None, "No DSS", None), (None, "dss welcome but no dss", None), (False, "pets welcome", None), (None, "no pets welcome", None), (None, None, None), (None, "Guarantor required", "unfortunately no pets")]
    df = spark.createDataFrame(rows, "pets_allowed boolean, description string, features string")
    flags = [sorted(r[0]) for r in df.select(signals.red_flags(df.columns)).collect()]
    assert flags == [["No DSS"], [], ["No pets"], ["No pets"], [], ["Guarantor required", "No pets"]]
    assert [r[0] for r in df.select(signals.bool_signal("pets_allowed", df.columns)).collect()] == [None, None, False, False, None, False]
