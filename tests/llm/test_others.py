"""Decontamination, sharding, toxicity, top-k, personal data and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.llm.decontaminate import decontaminate, find_contamination
from dwellspark.llm.pii import find_pii, listed, luhn, mod97
from dwellspark.llm.sharding import longest_first, shard
from dwellspark.llm.topk import top_k
from dwellspark.llm.toxicity import class_models, score_toxicity

from . import brute
from .conftest import clashing, word


@pytest.fixture(scope="module")
def items(spark, texts):
    rng = random.Random(5)
    rows = [(i, " ".join(word(rng) for _ in range(rng.choice([14, 25, 60])))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "one two"), (23, "Ha, HA ha"), (24, " ".join(texts[0].split()[5:30])), (25, " ".join(texts[1].split()[:13])), (25, "changed"), (None, "ab ba " * 20), (26, rows[0][1])]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("broadcast_windows", [10**6, 0])
def test_contamination(docs, texts, items, broadcast_windows):
    df, rows = items
    got = find_contamination(clashing(docs), df, broadcast_windows=broadcast_windows).collect()
    found = {r["doc_id"]: (r["contamination"]["n_words"], r["contamination"]["n_hit"], sorted(set(r["contamination"]["items"]))) for r in got}
    assert found == {i: (n, hit, its) for i, n, hit, its in brute.contamination(list(enumerate(texts)), rows)}
    assert sum(v[1] > 0 for v in found.values()) > 10


def test_decontaminated_documents_stay_as_they_are(docs, texts, items, empty, spark):
    df, rows = items
    bad = {i for i, n, hit, _ in brute.contamination(list(enumerate(texts)), rows) if hit and 20 * hit >= n}
    kept = decontaminate(docs, df)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - bad and kept.columns == docs.columns
    assert decontaminate(empty, df).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).filter("contamination.contaminated").count() == 0
    assert decontaminate(clashing(docs), df).columns == clashing(docs).columns and decontaminate(clashing(docs), df).filter("contamination <> 'contamination'").count() == 0


def test_shards(docs, texts, empty):
    got = shard(clashing(docs), shards=5).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    size = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    assert all(r.size == size[r.doc_id] and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got.itertuples(index=False) for r in [r])
    by_text = {}
    for r in got.to_dict("records"):
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["shard"]) == r["shard"]
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = got[got["size"] < 50_000].groupby("shard")["size"].sum()
    assert len(loads) >= 4
    assert shard(empty).count() == 0


def _plain_loads(sizes, shards):
    loads = [0] * shards
    for x in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += x
    return loads


@pytest.mark.parametrize("seed", range(6))
def test_longest_first_is_plain_scheduling(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([8, 9, 10, rng.randint(8, 40), rng.randint(8, 3000)]) for _ in range(3000)] + [rng.choice([1, 200_000])]
    counts = {}
    for x in sizes:
        counts[x] = counts.get(x, 0) + 1
    plan = longest_first(list(counts.items()), 24)
    assert all(sum(own) == counts[x] for x, own in plan)
    assert [sum(x * own[k] for x, own in plan) for k in range(24)] == _plain_loads(sizes, 24)


def test_shards_are_those_of_plain_scheduling(spark):
    rng = random.Random(1)
    texts = [None, "", "", *("x" * rng.randint(0, 30) + str(rng.randint(0, 50)) for _ in range(1500)), *["same"] * 400]
    got = shard(spark.createDataFrame([(i % 1700, t) for i, t in enumerate(texts)], "doc_id long, text string")).toPandas()
    assert len(got) == len(texts)
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    loads = got.groupby("shard")["size"].sum().to_dict()
    assert [loads.get(k, 0) for k in range(24)] == _plain_loads(groups.values(), 24)
    assert got[got.text_crc32 == zlib.crc32(b"same")].shard.nunique() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        toxic = rng.random() < 0.15
        words = [word(rng) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "moron", "stupid", "trashed", "trashing"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "idiot"), (5, rows[5][1]), (2002, "w " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, labels[5][1]), (None, 1), (7000, 1), (6, None)], "doc_id long, toxic int")
    got = score_toxicity(clashing(df), lab).select("doc_id", "text", "held_out", "score", "predicted").collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in score_toxicity(df, lab, broadcast_labels=0, broadcast_rows=0).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-5 for r in got), "joins give what the scan gives"
    other = score_toxicity(df.withColumnsRenamed({"doc_id": "Id"}).selectExpr("Id", "text", "1 as Score", "2 as held_OUT"), lab.withColumnRenamed("doc_id", "ID"), doc_id="id")
    assert other.columns == ["Id", "text", "held_out", "score", "predicted"] and other.count() == len(rows)
    assert score_toxicity(empty, lab).count() == 0
    none = score_toxicity(df, lab.limit(0)).select("score").collect()
    assert len(none) == len(rows) and all(0 <= r[0] <= 1 for r in none)


def test_class_models_are_distributions(spark):
    """Against plain counting; all characters after a history sum to one."""
    counts = {"ab": (3, 0), "abc": (1, 2), "b": (0, 4), "ñandú": (2, 1), "aaaa": (5, 0), "cab": (1, 1)}
    models, weights = class_models(spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, n0 long, n1 long"), order=3)
    seen: dict = {}
    for w, n in counts.items():
        marked = f"\x02{w}\x03"
        for i in range(1, len(marked)):
            k = (marked[max(0, i - 2) : i], marked[i])
            seen[k] = tuple(a + b for a, b in zip(seen.get(k, (0, 0)), n))
    left = {}
    for h, b in seen:
        left[h[1:], b] = left.get((h[1:], b), 0) + 1
    single = {b: sum(sum(n) for (_, c), n in seen.items() if c == b) for b in {b for _, b in seen}}
    total, d, shared_weight = sum(single.values()), 0.75, 5.0

    def cont(h, b):
        own = [c for (x, _), c in left.items() if x == h]
        return (max(left.get((h, b), 0) - d, 0) + d * len(own) * (single.get(b, 0) + 1) / (total + len(single) + 1)) / sum(own)

    def shared(h, b):
        own = [sum(n) for (x, _), n in seen.items() if x == h]
        return (max(sum(seen.get((h, b), (0, 0))) - d, 0) + d * len(own) * cont(h[1:], b)) / sum(own)

    def prob(k, h, b):
        own = [n[k] for (x, _), n in seen.items() if x == h]
        return (max(seen.get((h, b), (0, 0))[k] - d, 0) + (shared_weight + d * sum(n > 0 for n in own)) * shared(h, b)) / (sum(own) + shared_weight)

    rows = models.collect()
    assert {(r["history"], r["char"]) for r in rows} == set(seen)
    for r in rows:
        assert all(abs(r[f"p{k}"] - prob(k, r["history"], r["char"])) < 1e-12 for k in (0, 1))
    for r in weights.collect():
        for k in (0, 1):
            assert abs(sum(prob(k, r["history"], b) for b in [*single, "?"]) - 1) < 1e-12
            assert abs(prob(k, r["history"], "?") - r[f"share{k}"] * shared(r["history"], "?")) < 1e-12


@pytest.mark.parametrize(("block", "group"), [(1 << 15, 4096), (70, 3)])
def test_top_k(spark, block, group):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.4, 6)]) for i in range(400)]
    vectors += [(i, vectors[3][1]) for i in range(400, 420)] + [(420, [0.0] * 6), (421, [1e5, -1e5, 0.0, 0.0, 0.0, 0.0]), (422, [0.5, 0.5]), (423, []), (424, [7e4, 1e9]), (425, [1.0, 65536.0])]
    vectors += [(3, [2.0, 0.0]), (3, [5.0, 0.0]), (50, vectors[50][1]), (100, [1e5, 1.0]), (100, [1e5, 1.0])]
    rows = [*vectors, (500, None), (501, [None] * 6), (502, [float("nan")] * 6), (550, [float("inf")] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    exact = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    expected = []
    for n, (q, own) in enumerate(exact):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(exact) if m != n)
            expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    got = top_k(df, "vec_id % 50 = 0", block_rows=block, query_rows=group).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_top_k_of_few_or_none_or_too_large(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [100000.0, 0.0]), (2, [70000.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, "vec_id = 0").orderBy("rank").collect()] == [(0, 1, 1, 6553600000), (0, 2, 2, 4587520000)]
    assert top_k(df.limit(0), "true").count() == 0 and top_k(df, "vec_id = 9").count() == 0
    large = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        top_k(large, "true").collect()


def test_pii(spark, empty):
    rng = random.Random(9)
    parts = ["a.b@c.d", "@x.y", "a@b.com_x@y.z", "a@b@c.de", "..@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112", "+44 (20) 7946-0958", "+1--2", "+123456789012345678", "card", " ", "\n", "é", "\U0001f600", "12", "-", "0", ".", "+", "79927398713", "x", "5500005555555559 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += [None, "", "1.2.3.4 " * 500, "9" * 20_000, "a" * 30_000, "a@b" + ".c" * 20_000, "+1" + " " * 20_000, "4111111111111111 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.filter("pii", lambda x: x["rank"] < 4)
    got = {r["doc_id"]: r["s"] for r in find_pii(clashing(df, keep=("pii",))).select("doc_id", listed(base).alias("s")).collect()}
    assert got == {i: brute.pii(t) for i, t in enumerate(texts)}
    assert find_pii(empty).count() == 0


def test_validators(spark):
    cards = ["4111111111111111", "4111111111111112", "0", "79927398713", "18", "91"]
    ibans = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "GB83WEST12345698765432", "DE89370400440532013000"]
    df = spark.createDataFrame([(c,) for c in cards], "x string").select(luhn(F.col("x")))
    assert [r[0] for r in df.collect()] == [brute.luhn(c) for c in cards]
    df = spark.createDataFrame([(c,) for c in ibans], "x string").select(mod97(F.col("x")))
    assert [r[0] for r in df.collect()] == [True, True, False, True]
    spans = find_pii(spark.createDataFrame([("my account GB82 WEST 1234 5698 7654 32 is", )], "text string")).first()["pii"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("iban", 11, 38)] and spans[0]["score"] > 0.8


def test_account_numbers_end_where_their_country_says(spark):
    good = "DE89370400440532013000"
    spaced = "GB29 NWBK 6016 1331 9268 19"
    rows = [(f"IBAN {good} Please pay", good), (f"IBAN {good} please", good), (f"{spaced} Thanks", spaced), (f"account {good} BIC COBADEFFXXX", good), (good + "X", None), ("DE88370400440532013000", None), ("ZZ89370400440532013000", None)]
    got = {r["text"]: r["pii"] for r in find_pii(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()}
    assert {t: [t[s["start"] : s["end"]] for s in spans if s["kind"] == "iban"] for t, spans in got.items()} == {t: [w] if w else [] for t, w in rows}


def test_context_decides_on_secrets_and_numbers(spark):
    run = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(f'token = "{run}"', True), (f"see {run}", False), (f"{run} is the token", False), ("token " + "a" * 40, False), (f"API-Key:{run}", True), (f"SSN 123-45-6789.", True), ("part 123-45-6789", False), ("ssn 000-45-6789", False), (None, False)]
    got = find_pii(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()
    assert [bool(r["pii"]) for r in got] == [x for _, x in rows]
    assert [(s["kind"], s["start"], s["end"]) for s in got[0]["pii"]] == [("secret", 9, 49)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    base = [" ".join(word(rng) for _ in range(rng.randint(40, 150))) for _ in range(300)]
    item = " ".join(word(rng) for _ in range(40))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(300 + i, base[i]) for i in range(20)]
    rows += [(400 + i, base[50 + i].replace(base[50 + i].split()[10], "edited", 1)) for i in range(10)]
    rows += [(500 + i, f"{base[100 + i][:150]} {item} idem") for i in range(5)]
    toxic = [(600 + i, " ".join(w for t in zip(base[200 + i % 90].split()[:20], ["idiot", "moron", "stupid"] * 7) for w in t)) for i in range(60)]
    rows += toxic + [(700, None), (701, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(600 <= i < 700)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id").distinct().collect()}
    assert not kept & set(range(600, 660)), "toxic documents go"
    assert not kept & set(range(300, 320)), "copies go"
    assert not kept & set(range(500, 505)), "contaminated documents go"
    assert len(kept & set(range(400, 410))) <= 2, "near copies go"
    assert set(range(300)) <= kept, "clean documents stay"
    assert len(kept & {700, 701}) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
