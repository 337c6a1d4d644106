import random

import pytest

SYLLABLES = "an the re ti on ou er st ha in nd ed li qu é ß ñ".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, runs, odd spaces, nothing at all, and one very long one."""
    rng = random.Random(7)
    base = [" ".join(word(rng) for _ in range(rng.randint(3, 260))) for _ in range(40)]
    passage = " ".join(word(rng) for _ in range(70))
    out = list(base)
    out += base[:6] + base[:2]
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{' '.join(word(rng) for _ in range(20))} {passage} {' '.join(word(rng) for _ in range(20))}" for _ in range(6)]
    out += [None, "", "   \n\t", "one", "one two", "One  two\nTHREE, four.", "ha " * 130, "x " + "ha " * 90 + "y", "ab ba " * 60, "ba " * 3 + "ab ba " * 40]
    out.append(" ".join(word(rng) for _ in range(30_000)) + " " + passage)
    out.append("\x00 a\x0bb c \U0001f600 d́ É İ ﬁ it's 12,000.")
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


#: Names that operators use inside, as extra columns.
CLASHING = ("row", "doc", "key", "host", "lines", "line", "score", "hashes", "items", "item", "n_words", "pii", "h1", "salt", "rank", "contamination", "fp", "before", "after", "n_dropped", "held_out", "_word", "_bits", "ids", "n")


def clashing(df, keep=()):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(c) for i, c in enumerate(CLASHING) if c not in keep})
