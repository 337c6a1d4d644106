"""Encoding whole texts with a tokenizer file, word by word.

The tokenizer drops white space and encodes each word by itself, so a text's ids
are its words' ids in order.  A batch's distinct words are found by dictionary
encoding, only words that this worker hasn't met lately are encoded, and the batch's ids
are gathered by index.  The memo has two generations of ``MEMO_WORDS`` words at most.

If the tokenizer's own pattern is the known one, words are also cut where it always
cuts (beside ASCII digits, between letters and ASCII punctuation), and A-Z lower-cased
where nothing can combine with them, which leaves far fewer distinct words.  Characters
beyond Latin-1 letters are never cut off from their neighbours.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .wordhash import text_buffers

#: Characters of text (about) that are taken together.
CHUNK_BYTES = 1 << 21
#: Words after which a worker starts a new generation and forgets the one before the last.
MEMO_WORDS = 200_000
#: Words that are encoded in one call.
JOINED = 256

WORD_END = "</w>"
#: The pattern (and what comes before it) for which words may be cut further.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_STEPS = ["NFC", "Replace", "Lowercase"]

#: Kinds of bytes.
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, LATIN, OTHER = range(7)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = MARK
    out[0x27] = APOSTROPHE
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    return out


def _cuts(known: bool) -> np.ndarray:
    """Whether words are cut between two kinds of bytes (numbered 8 * first + second)."""
    out = np.zeros((8, 8), bool)
    out[SPACE, :] = out[:, SPACE] = True
    if known:
        sure = [LETTER, LATIN, DIGIT, MARK, APOSTROPHE]
        out[DIGIT, sure] = out[sure, DIGIT] = True
        for letter in (LETTER, LATIN):
            out[letter, [MARK, APOSTROPHE]] = True
            out[MARK, letter] = True
    out[SPACE, SPACE] = False
    return out.reshape(-1)


KIND = _kinds()
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
PLAIN_CUTS, KNOWN_CUTS = _cuts(False), _cuts(True)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenChunk(NamedTuple):
    """Rows ``first`` and on of a batch: all their ids, and where each row's ids begin (and the end)."""

    first: int
    ids: np.ndarray
    bounds: np.ndarray


class WordTokenizer:
    """For tokenizers that drop white space; others are refused."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self._ids(["a b", "a  b\n"]) != [self._ids(["a"])[0] + self._ids(["b"])[0]] * 2:
            raise ValueError(f"{path}: not a tokenizer that encodes words by themselves")
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        patterns = [x["pattern"].get("Regex") for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        self.known = patterns == [KNOWN_PATTERN] and steps == KNOWN_STEPS
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Put words into the memo: runs of letters many at once (each ends in one word-end token), others alone."""
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            ids = np.array(self._ids([" ".join(some)])[0], self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, at = ids.tobytes(), np.concatenate([[0], cuts]) * self.dtype.itemsize
                for w, a, b in zip(some, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    self.memo[w] = raw[a:b]
            else:
                other += some
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            for w, ids in zip(some, self._ids(some), strict=True):
                self.memo[w] = np.array(ids, self.dtype).tobytes()

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and where each word's ids begin (and the end)."""
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = [w for w in words if w not in memo]
        memo.update((w, older[w]) for w in new if w in older)
        self._learn([w for w in new if w not in older])
        raw = [memo[w] for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        return np.frombuffer(b"".join(raw), self.dtype), np.concatenate([[0], np.cumsum(sizes)])

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts laid end to end, and each text's first word (and the end)."""
        known = self.known and b"<|" not in data.tobytes()
        kind = KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1 letters, but for two signs
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LATIN
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (KNOWN_CUTS if known else PLAIN_CUTS)[kind[:-1] * np.uint8(8) + kind[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts)
        starts = starts[:-1]
        if known:
            lower = LOWER[data]
            before_other = np.flatnonzero(kind[1:] == OTHER)  # may combine with the letter
            lower[before_other] = data[before_other]
            data = lower
        word = kind[starts] != SPACE
        at = np.concatenate([[0], np.cumsum(sizes[word])])
        buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[kind != SPACE]))]
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, buffers), np.searchsorted(starts[word], offsets)

    def encode(self, column: pa.Array, end_id: int | None = None, limit: int = CHUNK_BYTES) -> Iterator[TokenChunk]:
        """Encode a column of whole texts (null: empty), with ``end_id`` after each text."""
        at, raw = text_buffers(column)
        i, n = 0, len(at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            data = raw[at[i] : at[j]]
            if any(s.encode() in data.tobytes() for s in self.specials if " " in s or "\n" in s):
                raise ValueError("special tokens with white space are not supported")
            words, offsets = self._words(data, at[i : j + 1] - at[i])
            words = words.dictionary_encode()
            flat, places = self._table(words.dictionary.to_pylist())
            yield TokenChunk(i, *self._gather(flat, places, words.indices.to_numpy(), offsets, end_id))
            i = j

    def _gather(self, flat: np.ndarray, at: np.ndarray, index: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end_id is not None:  # as a last word of each text
            at = np.append(at, at[-1] + 1)
            flat = np.append(flat, self.dtype.type(end_id))
            index = np.insert(index, offsets[1:], len(at) - 2)
            offsets = offsets + np.arange(len(offsets))
        sizes = (at[1:] - at[:-1])[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(at[index] - ends[:-1], sizes)
        where += np.arange(ends[-1])
        return flat[where], ends[offsets]


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    return WordTokenizer(path)
