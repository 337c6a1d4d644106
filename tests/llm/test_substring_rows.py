"""Substring dedup of rows that share an id, or have none."""

from dwellspark.llm.substrings import dedup_substrings


def test_only_the_row_that_is_a_copy_goes(spark):
    t, u, v, w = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuvw")
    rows = spark.createDataFrame([(1, t), (5, t), (5, u), (6, u + " x"), (None, t), (None, v), (None, w), (None, v)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in dedup_substrings(rows, with_text=True).collect())
    assert got == sorted([("1", 0, t), ("5", 60, ""), ("5", 0, u), ("6", 60, "x"), ("None", 60, ""), ("None", 0, v), ("None", 0, w), ("None", 0, v)])


def test_words_are_put_together_without_hashes_where_nothing_repeats(monkeypatch):
    """Rows without repeated windows cost no hashing; kept words come joined by single spaces, whatever stands between them."""
    import pyarrow as pa

    from dwellspark.llm import substrings, wordhash

    def refused(*_):
        raise AssertionError("hashed")

    monkeypatch.setattr(wordhash, "word_hashes", refused)
    texts = ["", " ", "a", "ab", " a\t\tb\r\n c ", "é\x1cß \x00 x", None, "w " * 60, "x", "y z"]
    n, lists = len(texts), pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(texts, pa.string()), pa.array([None] * n, lists), pa.array([None] * n, lists), pa.array([k == 7 for k in range(n)])],
        names=["doc_id", "text", "h1", "h2", "whole"],
    )
    (out,) = substrings._apply(50, True)(iter([batch]))
    plain = [[w.decode() for w in (t or "").encode().split()] if t != "é\x1cß \x00 x" else ["é\x1cß", "\x00", "x"] for t in texts]
    assert out.column("n_words").to_pylist() == [*map(len, plain)]
    assert out.column("n_removed").to_pylist() == [60 if k == 7 else 0 for k in range(n)]
    assert out.column("kept").to_pylist() == ["" if k == 7 else " ".join(w) for k, w in enumerate(plain)]
