"""Packing and token output against the tokenizer itself."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dwellspark.llm import packing, rans
from dwellspark.llm.tokens import default_tokenizer, worker_tokenizer

from .brute import crc
from .conftest import clashing


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB.,'’ \n\t<|endoftext|>é́ΣİǅΑ1½\x1c\x85日ß"), max_size=25), max_size=8))
def test_encoding_is_the_tokenizers(parts):
    ids = [c.ids[a:b].tolist() for c in worker_tokenizer(default_tokenizer()).encode(pa.array(parts, pa.string())) for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True)]
    whole = Tokenizer.from_file(default_tokenizer()).encode_batch(parts, add_special_tokens=False)
    assert ids == [e.ids for e in whole]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("stSTrelHJ'’\"-_. 19é×÷ÉÀ\u0331\u0308\u030c\r\x0b\x00½²—🙂"), max_size=40), max_size=5))
def test_cuts_are_the_tokenizers(parts):
    encoder = worker_tokenizer(default_tokenizer())
    assert encoder.known
    whole = [e.ids for e in Tokenizer.from_file(default_tokenizer()).encode_batch(parts, add_special_tokens=False)]
    for known in (True, False):
        encoder.known = known
        got = [c.ids[a:b].tolist() for c in encoder.encode(pa.array(parts, pa.string())) for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True)]
        encoder.known = True
        assert got == whole


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1), st.just(60))
def test_plan_places_every_piece_once(histogram, capacity):
    taken = {}
    for length, low, high, each, first, offset in packing.plan_best_fit(histogram, capacity):
        for rank in range(low, high):
            at = (first + (rank - low) // each, offset + (rank - low) % each * length)
            for token in range(at[1], at[1] + length):
                assert token < capacity
                assert taken.setdefault((at[0], token), (length, rank)) == (length, rank)
    assert len(taken) == sum(k * v for k, v in histogram.items())
    bins = {}
    for b, token in taken:
        bins[b] = max(bins.get(b, 0), token + 1)
    assert sum(bins.values()) == len(taken), "gapless from 0"
    assert sorted(bins) == list(range(len(bins)))


def test_packing(docs, texts, reference):
    got = packing.pack_documents(clashing(docs), capacity=256).toPandas()
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert len(got) == sum(-(-len(v) // 256) for v in ids.values())
    for r in got.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 256 and r.length == len(piece) and r.ids_crc32 == crc(piece)
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert by.length.sum().max() <= 256
    assert by.ngroups <= -(-got.length.sum() // 256) + 1


def test_sequences_hold_their_documents(docs, texts, reference):
    got = packing.packed_sequences(docs.filter("doc_id < 30"), capacity=512).collect()
    held = sorted(t for r in got for t in r["ids"])
    assert held == sorted(t for x in texts[:30] for t in [*reference.encode(x or "", add_special_tokens=False).ids, 0])


def test_packing_of_nothing_and_repeats(spark, empty):
    assert packing.pack_documents(empty).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = packing.pack_documents(same).toPandas()
    assert len(got) == 3 and got.sequence_id.nunique() == 1 and sorted(got.offset) == sorted(set(got.offset))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40_000 // 40), st.integers(1, 40))
def test_blocks_decode_to_what_was_encoded(some, times):
    ids = np.array(some * times, np.int64)
    counts = np.bincount(ids, minlength=301) + np.eye(1, 301, 7, dtype=int)[0]
    coder = rans.Coder(rans.scaled_frequencies(counts))
    payload, checkpoints = coder.encode(ids)
    assert (coder.decode(payload, checkpoints, len(ids)) == ids).all()


def test_frequencies_sum_up():
    for counts in (np.array([1]), np.array([10**12, 1, 0, 1]), np.ones(50_000, int), np.array([0, 0])):
        f = rans.scaled_frequencies(counts)
        assert ((f > 0) == (counts > 0)).all() and f.sum() in (0, 1 << rans.SCALE_BITS)


def test_token_output(docs, texts, reference, spark):
    path = rans.encode_corpus(clashing(docs))
    got = rans.documents_of(rans.read_tokens(spark, path, with_ids=True)).orderBy("doc_id").collect()
    start = 0
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), crc(ids))
        assert list(r["ids"]) == ids
        start += len(ids)


def test_documents_longer_than_a_block(spark, reference):
    long = "ha re on " * 60_000
    rows = spark.createDataFrame([(2, "b"), (1, long), (3, None), (1, "again")], "doc_id long, text string")
    path = rans.encode_corpus(rows)
    got = {(r["doc_id"], r["n_tokens"]): r for r in rans.documents_of(rans.read_tokens(spark, path, with_ids=True)).collect()}
    assert {(r["doc_id"], r["n_tokens"]): r for r in rans.read_documents(spark, path, with_ids=True).collect()} == got
    ids = [*reference.encode(long, add_special_tokens=False).ids, 1]
    assert len(ids) > rans.BLOCK_IDS
    r = got[1, len(ids)]
    assert r["ids_crc32"] == crc(ids) and list(r["ids"]) == ids
    assert sum(n for _, n in got) == max(x["start"] + x["n_tokens"] for x in got.values())


def test_wrong_checksum_is_found(spark, docs):
    path = rans.encode_corpus(docs.filter("doc_id < 5"))
    from pyspark.sql import functions as F

    spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.col("crc32") + 1).write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{path}-bad/frequencies")
    with pytest.raises(Exception, match="wrong checksum"):
        rans.read_tokens(spark, f"{path}-bad").collect()


def test_token_output_of_nothing(spark, empty):
    assert rans.documents_of(rans.read_tokens(spark, rans.encode_corpus(empty))).count() == 0
