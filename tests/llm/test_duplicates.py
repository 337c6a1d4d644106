"""SimHash, substring and line dedup against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.llm import components, simhash, workers
from dwellspark.llm.components import connected_components
from dwellspark.llm.lines import drop_boilerplate, host_of, without_boilerplate
from dwellspark.llm.simhash import drop_near_duplicates, fingerprint_links, simhash_components
from dwellspark.llm.substrings import dedup_substrings

from . import brute
from .conftest import clashing


def test_simhash(docs, texts):
    got = {r["doc_id"]: r for r in simhash_components(clashing(docs)).collect()}
    fps = [brute.fingerprint(t) for t in texts]
    expected = brute.components(list(range(len(texts))), fps)
    assert {k: (int(r["fingerprint"], 16), r["component_id"]) for k, r in got.items()} == {i: (fps[i], expected[i]) for i in range(len(texts))}


@pytest.mark.parametrize("run", [0, 3, 32])
def test_links_of_crowded_fingerprints(spark, run):
    """With a small ``run`` all or some variants are crowded, and full balls decide."""
    rng = random.Random(run)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)} | {rng.getrandbits(64) for _ in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = fingerprint_links(df, run=run).collect()
    pairs = [(int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in links]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = brute.components(fps, fps)
    groups = lambda f: sorted(sorted(x for x in fps if f(x) == r) for r in {f(x) for x in fps})
    assert groups(find) == groups(expected.get)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 101)] + [(200, k) for k in range(201, 300)] + [(7, 7)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 105: 100, 101: 100, **dict.fromkeys(range(200, 300), 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_groups_are_thinned_before_rounds(spark, monkeypatch):
    """All pairs of 400 nodes, a chain, and pairs: no round may join all edges of the dense group."""
    read, state = [], components._state
    monkeypatch.setattr(components, "_state", lambda edges: (read.append(edges.count()), state(edges))[1])
    dense = [(a, b) for a in range(400) for b in range(a)]
    rest = [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + 2 * i, 2001 + 2 * i) for i in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(dense + rest, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(41)} | {2000 + i: 2000 + i // 2 * 2 for i in range(80)}
    assert read[0] <= 5 * len(got)


def test_near_duplicates_leave_one_of_each_group(spark, docs, texts):
    kept = {r["doc_id"] for r in drop_near_duplicates(clashing(docs)).collect()}
    words = [brute.ALNUM.findall(brute.lower(t)) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    for i, t in enumerate(texts):
        same = [j for j in range(len(texts)) if (texts[j] or "") == (t or "")]
        assert len(kept & set(same)) <= 1
        if i not in kept:
            near = [j for j in kept if (texts[j] or "") == (t or "") or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
            assert near, f"{i} went without anything like it staying"
    copies = [i for i in range(46, 48)] + [i for i in range(40, 46)]
    assert not kept & set(copies)
    edited = [i for i in range(48, 60) if len(words[i]) > 60]
    assert sum(i not in kept for i in edited) >= 0.8 * len(edited)


def test_near_copies_that_are_like_their_original_alone(spark):
    """Copies with edits of their own; the original, which links them, doesn't have the smallest id."""
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    copies = []
    for _ in range(12):
        own = list(words)
        for at in rng.sample(range(10, 390, 6), 6):
            own[at] = f"e{rng.randint(0, 10**6)}"
        copies.append(" ".join(own))
    rows = [*enumerate(copies), (50, " ".join(words))] + [(60 + i, " ".join(rng.sample(words, 400))) for i in range(2)]
    kept = {r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {60, 61} <= kept, "the same words in another order are another text"
    assert len(kept - {60, 61}) == 1


def test_near_copies_whose_head_is_unlike_them(spark):
    """Several hundred copies with two words exchanged; texts of the same words in other orders have smaller ids."""
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    orders = [rng.sample(words, 400) for _ in range(3)]
    rows = [(i, " ".join(rng.sample(words, 400))) for i in range(40)]
    for i, at in enumerate(rng.sample(range(399), 300)):
        own = list(orders[i % 3])
        own[at], own[at + 1] = own[at + 1], own[at]
        rows.append((100 + i, " ".join(own)))
    kept = {r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(40), 100, 101, 102}


def test_near_duplicates_under_any_names_and_ids(spark, empty):
    rows = spark.createDataFrame([("b", "x y", 1, 2), ("a", "x y", 3, 4), (None, "x y", 5, 6), ("c", None, 7, 8)], "Doc_ID string, text string, score int, Score int")
    got = drop_near_duplicates(rows)
    assert got.columns == rows.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("a", "x y", 3, 4), (None, "x y", 5, 6), ("c", None, 7, 8)]))
    assert drop_near_duplicates(empty).count() == 0


def test_near_duplicates_without_ids(spark, empty):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in drop_near_duplicates(rows).collect()) == ["3", "None", "None"]
    assert drop_near_duplicates(empty).count() == 0
    assert simhash_components(empty).count() == 0
    assert {r["component_id"] for r in simhash_components(rows).collect()} == {None, 3}


def test_substrings(docs, texts):
    expected = brute.substrings(list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_substrings(clashing(docs)).collect()}
    assert got == expected
    assert sum(v[1] for v in expected.values()) > 1000


@pytest.mark.parametrize("rounds", [1, 9])
def test_substrings_whatever_the_rounds(docs, texts, rounds):
    expected = brute.substrings(list(enumerate(texts)), window=20)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_substrings(docs, window=20, rounds=rounds).collect()}
    assert got == expected


def test_substrings_of_odd_tables(spark, empty):
    assert dedup_substrings(empty).count() == 0
    t = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(5, t), (None, t), (5, t), (1, t + " x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in dedup_substrings(rows, with_text=True).collect())
    assert got == [("1", 0, t + " x"), ("5", 60, ""), ("5", 60, ""), ("None", 60, "")]


def _plain_lines(rows, ratio, least):
    from collections import Counter

    total, seen = Counter(h for _, _, h in rows), Counter()
    for _, t, h in rows:
        seen.update((h, x) for x in {line.strip(" ") for line in (t or "").split("\n")} - {""})
    bad = {(h, x) for (h, x), n in seen.items() if n >= least and n > ratio * total[h]}
    out = {}
    for i, t, h in rows:
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines = t.split("\n")
        left = [x for x in lines if not x.strip(" ") or (h, x.strip(" ")) not in bad]
        out[i] = ("\n".join(left), len(lines), len(lines) - len(left))
    return out


@pytest.mark.parametrize("broadcast_lines", [10**6, 0])
def test_lines(spark, broadcast_lines):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 6))]
        if host == "a" and rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), "  subscribe now ")
        rows.append((i, rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join(lines), host))
    rows += [(200 + i, "only boilerplate\n\n", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in drop_boilerplate(clashing(df), broadcast_lines=broadcast_lines).collect()}
    assert got == _plain_lines(rows, 0.1, 2)
    assert sum(v[2] for v in got.values()) > 10
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_hosts_of_urls(spark):
    urls = [("https://A.Example.org:80/x", "a.example.org"), ("http://u@h.net?q", "h.net"), ("h.net/x", None), (None, None), ("ftp://[::1]:2/", "[::1]")]
    got = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == [h for _, h in urls]
    df = spark.createDataFrame([(f"http://h.net/{i}", f"menu\n{i}", i) for i in range(5)], "URL string, Text string, N_Lines long")
    out = without_boilerplate(df, source="url", text="text", is_url=True)
    assert out.columns == df.columns and sorted(tuple(r)[1:] for r in out.collect()) == [(str(i), i) for i in range(5)]


def test_columns_stay(docs):
    wide = clashing(docs, keep=("n_dropped",))
    assert drop_near_duplicates(wide).columns == wide.columns
    kept = drop_boilerplate(wide)
    assert [c for c in kept.columns if c not in ("n_lines", "n_dropped")] == [c for c in wide.columns if c != "n_lines"]
    assert kept.filter(F.col("lines").isNotNull() & (F.col("lines") != "lines")).count() == 0
    assert simhash.RADIUS == 3


@pytest.mark.parametrize("heads", [40, 256])
def test_open_pairs_are_all_judged(spark, monkeypatch, heads):
    """Texts edited from one, more or less like each other than the threshold: links join what brute force joins."""
    monkeypatch.setattr(simhash, "HEADS", heads)
    pick = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in pick.sample(range(60), pick.choice([1, 1, 2, 2, 3])):
            words[at] = f"x{at}" if pick.random() < 0.5 else f"x{i}q{at}"
        texts.append(" ".join(words))
    texts += ["the of and the of", "the of", "of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    sets = workers.map_batches(docs, simhash._shingle_sets(5), "doc long, shingles binary")
    ties = spark.createDataFrame([(0, i) for i in range(1, len(texts))], "a long, b long")
    links = simhash._judge_open(ties, ties.limit(0), sets, 0.8).collect()
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    assert {(x.a, x.b) for x in links} <= similar

    def components(pairs):
        root = list(range(len(texts)))
        for _ in texts:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert components(similar) == components({(x.a, x.b) for x in links})
    assert len(set(components(similar))) > 3
