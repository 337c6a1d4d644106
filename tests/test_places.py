"""Places by name against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import fixed, fuzzy
from dwellspark.operators import places

WORDS = "kings cross st pancras waterloo bank oval angel old street elephant castle canary wharf brixton baker bond green park vauxhall ealing".split()


def typo(rng, s):
    for _ in range(rng.choice([0, 1, 1, 2])):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(4)
        s = s[:i] + rng.choice("aeiourst") + s[i:] if kind == 0 else s[:i] + s[i + 1 :] if kind == 1 else s[:i] + rng.choice("aeiou") + s[i + 1 :] if kind == 2 else s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]
    return s


def names(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(n)]


def table(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string").repartition(3)


def test_aliases_and_lookups(spark):
    rows = [("King's Cross-St Pancras", "King's Cross-St Pancras", 5), ("Oval", "Oval", 2), ("oval!", "The Oval", 1), ("É", "é", 0), (None, None, 3), ("ab", "ab", 4), ("a b c", "a b c", 6)]
    index = places.alias_index(spark.createDataFrame(rows, "canonical string, phrase string, place long"))
    got = {(r["name"], r["place"], r["alias"], r["compact"]) for r in index.collect()}
    assert got == {
        *(("kings cross st pancras", 5, a, a.replace(" ", "")) for a in ("kings cross st pancras", "kings cross", "cross st", "st pancras", "kings cross st", "cross st pancras")),
        ("oval", 1, "oval", "oval"), ("oval", 1, "the oval", "theoval"), ("a b c", 6, "a b c", "abc"),
    }
    assert {r["canonical"] for r in index.filter("name = 'oval'").collect()} == {"oval!"}
    both = spark.createDataFrame([("ab cd", "ab cd", 2), ("abc d", "abc d", 1)], "canonical string, phrase string, place long")
    assert [r["alias"] for r in places.lookups(places.alias_index(both)).filter("family = 2").collect()] == ["abc d"]


def test_index_is_kept(spark, tmp_path):
    built = []

    def rebuild():
        built.append(1)
        return places.alias_index(spark.createDataFrame([("Oval", "Oval", 1)], "canonical string, phrase string, place long"))

    path = f"file://{tmp_path}/index"
    assert [places.load_index(spark, path, rebuild).count() for _ in range(2)] == [1, 1] and built == [1]


@pytest.mark.parametrize(("said", "want"), [("waterloo0", "waterloo"), ("KX", fuzzy.KINGS_CROSS_NAME), ("n1 9aa", "n1 9aa"), ("se11", "se11"), ("King's  X station", fuzzy.KINGS_CROSS_NAME), ("ask agent", ""), ("old-street 22", "old street"), ("123456", "")])
def test_typed_name(spark, said, want):
    assert table(spark, [said], "s").select(places.typed_name(F.col("s"))).first()[0] == want


def test_holding(spark):
    texts = sorted({n.replace(" ", x) for n in names(1, 60) for x in (" ", "")} | {"é", "a", "ab", "aéb", "%_%", "x" * 400})
    needles = sorted({t[i:j] for t in texts[::5] for i, j in ((0, 1), (0, 2), (1, 5), (0, len(t)))} - {""} | {"zzz", "%", "_%", "éb", "x" * 7})
    got = {tuple(r) for r in places.holding(table(spark, needles, "needle"), table(spark, texts, "text")).collect()}
    assert got == {(a, t) for a in needles for t in texts if a in t}


def test_region_of(spark):
    regions = spark.createDataFrame([(0, "South Bank", 1.0), (1, "Bank", 2.0), (2, "bank", 3.0), (3, "Oval", 4.0), (4, "Old Oval Street", 5.0)], "place int, name string, lat double")
    said = ["bank", "SOUTH BANK ", "ban", "old oval", "the oval", "x", "", None]
    got = {r["keyword"]: r["place"] for r in places.region_of(table(spark, said, "keyword"), regions).collect()}
    assert got == {"bank": 1, "SOUTH BANK ": 0, "ban": 0, "old oval": 3, "the oval": 3}


def test_scores_of_many_pairs():
    rng = random.Random(8)
    pairs = [(typo(rng, rng.choice(WORDS))[: rng.randint(0, 9)], "".join(names(rng.random(), 1))) for _ in range(3000)] + [("a", "b"), ("", "a"), ("a", ""), ("éa", "aé")]
    a, b = map(list, zip(*pairs, strict=True))
    assert fuzzy.edits_of_pairs(a, b).tolist() == [fuzzy.edits(x, y) for x, y in pairs]
    assert fuzzy.alias_scores(a, b).tolist() == [fuzzy.alias_score(x, y) for x, y in pairs]
    assert fuzzy.edits_of_pairs([], []).tolist() == [] and fuzzy.alias_scores([], []).tolist() == []


@pytest.mark.parametrize("seed", range(3))
def test_best_aliases_lose_nothing(spark, seed):
    rng = random.Random(seed)
    index = places.alias_index(spark.createDataFrame([(n, n, i) for i, n in enumerate(names(seed, 40))], "canonical string, phrase string, place long")).cache()
    typed = sorted({typo(rng, n)[: rng.choice([2, 3, 5, 9, 40])] for n in names(seed + 10, 120)} | {"".join(rng.choice("abeikrst") for _ in range(rng.randint(1, 8))) for _ in range(60)} | {"bdg", "wtaerloo0", "kx", "", "!", "baker street waterloo green park ealing brixton oval"})
    aliases = {(r["alias"], r["compact"]) for r in index.collect()}
    first = {(r["family"], r["key"]): r["alias"] for r in places.lookups(index).collect()}
    plain = {r["t"]: r["p"] for r in table(spark, typed, "t").select("t", places.typed_name(F.col("t")).alias("p")).collect()}
    want = {}
    for t, p in plain.items():
        exact = list(dict.fromkeys(first[k] for k in ((0, p), (1, p.replace(" ", "_")), (2, p.replace(" ", ""))) if k in first))
        scored = [(a, 1.0) for a in exact] or sorted(((a, s) for a, c in aliases if p and (s := fuzzy.alias_score(p.replace(" ", ""), c)) >= 0.80), key=lambda x: (-x[1], len(x[0]), x[0]))
        if scored:
            want[t] = [(a, round(s, 9)) for a, s in scored[:8]]
    got = {}
    for r in places.best_aliases(table(spark, typed, "typed"), index).orderBy("typed", "rank").collect():
        got.setdefault(r["typed"], []).append((r["alias"], round(r["score"], 9)))
    assert got == want and len(want) > 60


@pytest.mark.parametrize("seed", range(3))
def test_few_edits_lose_nothing(spark, seed):
    rng = random.Random(seed)
    known = sorted(set(names(seed, 80)) | {"a", "ab", "ba", "é", "aé"})
    typed = sorted({typo(rng, rng.choice(known)) for _ in range(200)} - {""} | {"ba", "b", "éa"})
    got = {tuple(r) for r in places.few_edits(table(spark, typed, "typed"), table(spark, known, "name")).collect()}
    allowed = lambda t: max(1, min(3, len(t) // 4))
    assert got == {(t, n, d) for t in typed for n in known if (d := fuzzy.edits(t, n)) <= allowed(t)}


def resolve(name, stations):
    """The reference order of ways, by loops."""
    keys = {}
    for s in stations:
        k = s.lower().strip()
        for form in (k, k[:-8] if k.endswith(" station") else f"{k} station"):
            keys[form] = s
    key = name.lower().strip()
    if key in keys:
        return keys[key], "exact", 0
    if (spelt := fixed.STATION_ABBREVIATIONS.get(key)) in keys:
        return keys[spelt], "abbreviation", 0
    for k, s in keys.items():
        if key in k or k in key:
            return s, "part", 0
    near = [(d, i, s) for i, (k, s) in enumerate(keys.items()) if (d := fuzzy.edits(key, k)) <= max(1, min(3, len(key) // 4))]
    return (min(near)[2], "edits", min(near)[0]) if near else None


def test_destination_station(spark):
    rng = random.Random(4)
    stations = list(dict.fromkeys(n.title() for n in names(5, 40) if len(n) > 6)) + ["Kings Cross St Pancras", "Bank", "Tottenham Court Road Station", "tottenham court road"]
    said = sorted({typo(rng, n) for n in names(6, 150)} | {"Kings X", "tcr", "the city", "oxfrd circus", " BANK ", "tottenham cuort raod"} - {""})
    got = {r["destination"]: (r["station"], r["way"], r["edits"]) for r in places.destination_station(table(spark, [*said, None, " "], "destination"), spark.createDataFrame(list(enumerate(stations)), "place int, name string")).collect()}
    assert got == {s: r for s in said if s.strip() and (r := resolve(s, stations))}
    assert {w for _, w, _ in got.values()} == {"exact", "abbreviation", "part", "edits"}
