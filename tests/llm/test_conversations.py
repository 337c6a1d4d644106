"""Conversation repair against every edit of small conversations, and against a plain search over whole strings."""

import hashlib
import itertools
import random
import re
from collections import defaultdict
from functools import cache
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from dwellspark.llm.queries import QUERIES
from dwellspark.llm.conversations import END, START, costs_to_go, damage, kind, labels, plan_repairs, repaired, report

from ..compare import SF_DIR
from .conftest import clashing

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """blank, duplicate, truncated or None of each row."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_edit(rows):
    """Cost and labels of the best of all edits, the result's rows."""
    gaps = [(), *itertools.product("ua", repeat=1), *itertools.product("ua", repeat=2)]
    best = None
    kinds = faults(rows)
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in kinds]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            said, out, cost = "", [], 0
            for i, gap in enumerate(put):
                said, cost = said + "I" * len(gap), cost + 3 * len(gap)
                out += [(NAMES[x], "") for x in gap]
                if i < len(rows):
                    e = edits[i]
                    said += e[0]
                    cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if e != "D" and kinds[i] == "truncated" else 0)
                    if e != "D":
                        out.append((NAMES[e[1]] if e[0] == "R" else rows[i][0], rows[i][1]))
            if (best is None or (cost, said) < best[:2]) and all(r for r, _ in out) and GRAMMAR.fullmatch("".join(r[0] for r, _ in out)):
                best = cost, said, out
    return best


def plain(rows):
    """The same by a search from the end that carries whole strings."""
    kinds = faults(rows)

    @cache
    def best(i, so_far, inserted):
        found = []
        if i == len(rows) and GRAMMAR.fullmatch(so_far):
            found.append((0, "", ()))
        if inserted < 2:
            for x in "ua":
                if ends := follow(so_far, x):
                    c, s, o = best(i, ends, inserted + 1)
                    found.append((c + 3, "I" + s, ((NAMES[x], ""), *o)))
        if i < len(rows):
            role, text = rows[i]
            c, s, o = best(i + 1, so_far, 0)
            found.append((c + 4, "D" + s, o))
            if kinds[i] in (None, "truncated"):
                more = 3 if kinds[i] else 0
                for label, cost, to in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    if ends := follow(so_far, to[:1]):
                        c, s, o = best(i + 1, ends, 0)
                        found.append((c + cost + more, label + s, ((to, text), *o)))
        return min(found, default=(1 << 40, "", ()))

    return best(0, "", 0)


def follow(so_far, x):
    """A short string that may be followed by what ``so_far + x`` may, or none."""
    return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}[so_far].get(x, "")


def summary(rows):
    """What the report gives of (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    said = [(r, x) for _, r, x in rows]
    kinds = faults(said)
    cost, audit, out = plain(tuple(said)) if len(said) > 3 else every_edit(said)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(said)]
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def in_order(rows):
    out = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())):
        out[conv].append((turn, role, text))
    return out


def broken(seed, n):
    rng = random.Random(seed)
    texts = ["Hello there.", "What is it?", "An answer!", "cut off", "", " \n", "Hello there.", "é ü.  ", "end,"]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unit"]), rng.choice(texts)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("seed", range(60))
def test_labels_against_every_edit(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(0, 3))]
    coded = [(kind(r[:1], f in ("blank", "duplicate"), f == "truncated"), 0) for (r, _), f in zip(rows, faults(rows), strict=True)]
    costs = costs_to_go(coded, END)
    cost, audit, _ = every_edit(rows)
    assert (costs[0][START], "".join(labels(coded, costs, START, True)[0])) == (cost, audit)
    assert plain(tuple(rows))[:2] == (cost, audit)


@pytest.mark.parametrize("chunk_bits", [1, 3, 17])
def test_report_and_rows(spark, chunk_bits):
    rows = broken(chunk_bits, 60)
    rng = random.Random(5)
    # a conversation far longer than a chunk, one of null id, one row very often, and a very long text
    rows += [(1000, i // 2, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"{i}.", f"{i}", "yes.", ""])) for i in range(220)]
    rows += [(None, 1, "user", "Q?"), (None, 2, "assistant", "A.")] + [(1001, 4, "user", "again.")] * 30 + [(1002, 0, "system", "s."), (1002, 1, "user", "w " * 300_000 + "."), (1002, 3, "assistant", "w " * 200_000)]
    df = clashing(table(spark, rows))
    plan = plan_repairs(df, chunk_bits=chunk_bits)
    want = {c: summary(x) for c, x in in_order(rows).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in report(df, df, plan).collect()}
    assert got == want
    out = defaultdict(list)
    for r in repaired(df, plan).orderBy("position").collect():
        assert r["position"] == len(out[r["conv_id"]])
        out[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(out[c]).encode()).hexdigest() for c in want} == {c: s[-1] for c, s in want.items()}


def test_damage(spark):
    rows = broken(9, 80) + [(None, None, "user", "x.y!z?"), (None, 3, None, None), (3, 70, None, "t"), (3, 71, "user", None)]
    want = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = [tuple(r) for r in damage(clashing(table(spark, rows))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    damaged, lost = in_order(want), {r[0] for r in rows} - {r[0] for r in want}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df = table(spark, rows)
    out = {r["conv_id"]: tuple(r)[1:] for r in report(damage(df), df).collect()}
    assert out == {c: summary(x) for c, x in damaged.items()} | dict.fromkeys(lost, nothing)


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for conv, turn, role, text in rows:
        fault = crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        damaged += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {r[0]: nothing for r in rows} | {c: summary(x) for c, x in in_order(damaged).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, SF_DIR).collect()} == want


def test_nothing(spark):
    none = table(spark, [(1, 1, "user", "a.")]).limit(0)
    assert report(none, none).count() == 0 and repaired(none).count() == 0
    gone = table(spark, [(7, 1, "user", "a.")])
    assert [tuple(r) for r in report(gone.filter(F.lit(False)), gone).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
