"""Recompression of word sequences: runs and pairs of symbols become new symbols.

A symbol's name is a hash of what it stands for, so equal content gets equal names in
all texts and tasks, without a dictionary.  The first round names runs of one word;
each round then deals symbols to two sides by a hash of their name and joins every
left symbol to a right one that follows it.  Whether two neighbours are joined depends
on these two alone, so what a symbol depends on stays close to it: ``low`` and ``high``
bound the words that its coming about depended on.  Equal stretches of words hold equal
symbols wherever these bounds lie inside the stretch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import wordhash as W

U64 = np.uint64
ROUNDS = 7
LEFT, RIGHT, RUN = U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F)


class Symbols(NamedTuple):
    """Symbols of a chunk in order; ``text`` numbers their texts; spans and bounds are word numbers of the chunk."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray


def _neighbour_bounds(s: Symbols, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low bound of what stands before each symbol and the high bound of what follows; beyond the text at its ends."""
    low, high = np.empty_like(s.low), np.empty_like(s.high)
    low[1:], high[:-1] = s.low[:-1], s.high[1:]
    first = np.concatenate([[True], s.text[1:] != s.text[:-1]])
    last = np.concatenate([s.text[1:] != s.text[:-1], [True]])
    low[first], high[last] = bounds[s.text[first]] - 1, bounds[s.text[last] + 1] + 1
    return low, high


def recompress(words: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of all texts after the run round and ``rounds`` pair rounds, from their words' hashes."""
    n = len(words)
    at = np.arange(n)
    s = Symbols(words, at, at + 1, at, at + 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
    if not n:
        return s
    before, after = _neighbour_bounds(s, bounds)
    same = (s.name[1:] == s.name[:-1]) & (s.text[1:] == s.text[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    name = np.where(size > 1, W.mix(s.name[first] + size.astype(U64) * RUN), s.name[first])
    s = Symbols(name, s.start[first], s.end[last], before[first], after[last], s.text[first])
    for k in range(rounds):
        before, after = _neighbour_bounds(s, bounds)
        right = (W.mix(s.name + U64((k + 1) * int(RUN) % (1 << 64))) & U64(1)).astype(bool)
        join = np.zeros(len(right), bool)
        join[:-1] = ~right[:-1] & right[1:] & (s.text[1:] == s.text[:-1])
        joined = np.concatenate([[False], join[:-1]])
        low, high = np.where(right, before, s.low), np.where(right, s.high, after)
        keep = np.flatnonzero(~joined)
        pair = join[keep]
        nxt = np.minimum(keep + 1, len(right) - 1)
        s = Symbols(
            np.where(pair, W.mix(s.name[keep] * LEFT + s.name[nxt] * RIGHT + U64(k)), s.name[keep]),
            s.start[keep],
            np.where(pair, s.end[nxt], s.end[keep]),
            np.where(pair, np.minimum(s.low[keep], s.low[nxt]), np.minimum(s.low[keep], low[keep])),
            np.where(pair, np.maximum(s.high[keep], s.high[nxt]), np.maximum(s.high[keep], high[keep])),
            s.text[keep],
        )
    return s
