"""Fuzzy matching of short names: edit distance with transpositions, windows, subsequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations (compact form) of one station family, and its name.
KINGS_CROSS = ("kx", "kingx", "kingsx", "kingscross", "kingcross", "kingscrossstpancras", "kingcrossstpancras", "kingsxstpancras", "kingsxstp", "kingscrossstn", "kingscrossstation")
KINGS_CROSS_NAME = "kings cross st pancras"


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, each part edited once (optimal string alignment)."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def allowed_edits(n: int) -> int:
    return 1 if n <= 6 else 2 if n <= 12 else max(2, round(n * 0.2))


def likeness(a: str, b: str) -> float:
    return 1.0 - edits(a, b) / max(len(a), len(b), 1)


def windows(n: int, name: str) -> list[str]:
    """The whole name, or for names much longer than n letters the windows of about n letters at either end."""
    if len(name) <= n + 2:
        return [name]
    out = []
    for size in sorted({max(3, n - 1), n, n + 1}):
        last = len(name) - size
        if last >= 0:
            starts = sorted({*range(min(3, last + 1)), *range(max(0, last - 2), last + 1)})
            out += [name[s : s + size] for s in starts]
    return out


def window_likeness(q: str, name: str) -> float:
    """Likeness to the whole name, or for much longer names to the best window of about q's length at either end."""
    if not q or not name:
        return 0.0
    return max((likeness(q, w) for w in windows(len(q), name)), default=0.0)


def edits_of_pairs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``edits`` of many pairs at once: the rows of all their tables go forward together."""
    if not len(a):
        return np.zeros(0, np.int64)

    def spelt(texts: Sequence[str]) -> np.ndarray:
        """A row of code points for each text, filled up with zeros."""
        width = max(map(len, texts))
        return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.int32).reshape(len(texts), width)

    x, y = spelt(a), spelt(b)
    x_size, y_size = np.array([*map(len, a)]), np.array([*map(len, b)])
    places = np.arange(y.shape[1] + 1, dtype=np.int32)
    last = np.repeat(places[None], len(a), axis=0)
    before, out = last, last[np.arange(len(a)), y_size]
    for i in range(x.shape[1]):
        letter = x[:, i : i + 1]
        row = np.minimum(last[:, 1:] + 1, last[:, :-1] + (letter != y))
        if i:
            swapped = (letter == y[:, :-1]) & (x[:, i - 1 : i] == y[:, 1:])
            row[:, 1:] = np.where(swapped, np.minimum(row[:, 1:], before[:, :-2] + 1), row[:, 1:])
        row = np.concatenate([np.full((len(a), 1), i + 1, np.int32), row], axis=1)
        before, last = last, np.minimum.accumulate(row - places, axis=1) + places
        out = np.where(x_size == i + 1, last[np.arange(len(a)), y_size], out)
    return out


def subsequence(q: str, name: str) -> float:
    """How well q abbreviates a name: 0 unless its letters occur in order."""
    if not q or len(q) > len(name):
        return 0.0
    at, places = -1, []
    for ch in q:
        at = name.find(ch, at + 1)
        if at < 0:
            return 0.0
        places.append(at)
    return 0.70 + 0.20 * len(q) / (places[-1] - places[0] + 1) + 0.10 * len(q) / len(name)


def alias_score(q: str, name: str) -> float:
    """The best of containment, edit distance and abbreviation, for compact forms."""
    if not q or not name:
        return 0.0
    less, more = sorted((len(q), len(name)))
    scores = [0.88 + 0.10 * less / more] if q in name or name in q else []
    like = window_likeness(q, name)
    if like >= 1.0 - allowed_edits(max(len(q), min(len(name), len(q) + 1))) / len(q):
        scores.append(0.68 + 0.20 * like + 0.12 * less / more)
    if 3 <= len(q) <= 8:
        scores.append(subsequence(q, name))
    return max(scores, default=0.0)


def least_edits(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """A lower bound of ``edits``: the letters that one text has and the other hasn't, whichever are more."""
    rows = np.repeat(np.arange(2 * len(a)), [*map(len, a), *map(len, b)])
    letters = np.frombuffer("".join([*a, *b]).encode("utf-32-le"), np.int32) % 64  # letters that fall together only lower the bound
    counts = np.bincount(rows * 64 + letters, minlength=128 * len(a)).reshape(2, len(a), 64)
    more = counts[0] - counts[1]
    return np.maximum(np.where(more > 0, more, 0).sum(axis=1), np.where(more < 0, -more, 0).sum(axis=1))


def alias_scores(queries: Sequence[str], names: Sequence[str]) -> np.ndarray:
    """``alias_score`` of many pairs at once. Windows whose letters alone differ too much aren't compared."""
    out = np.zeros(len(queries))
    pairs: list[tuple[int, str, str]] = []
    allowed = np.zeros(len(queries))
    for i, (q, name) in enumerate(zip(queries, names, strict=True)):
        if not q or not name:
            continue
        if q in name or name in q:
            out[i] = 0.88 + 0.10 * min(len(q), len(name)) / max(len(q), len(name))
        if 3 <= len(q) <= 8:
            out[i] = max(out[i], subsequence(q, name))
        allowed[i] = allowed_edits(max(len(q), min(len(name), len(q) + 1))) / len(q)
        pairs += [(i, q, w) for w in windows(len(q), name)]
    like = np.full(len(queries), -1.0)
    for a in range(0, len(pairs), 20_000):
        at, q, w = (np.array(c, object) for c in zip(*pairs[a : a + 20_000], strict=True))
        at = at.astype(np.int64)
        longest = np.array([max(len(x), len(y), 1) for x, y in zip(q, w, strict=True)])
        near = least_edits(q.tolist(), w.tolist()) <= allowed[at] * longest + 1e-9
        np.maximum.at(like, at[near], 1.0 - edits_of_pairs(q[near].tolist(), w[near].tolist()) / longest[near])
    for i in np.flatnonzero(like >= 0.0).tolist():
        q, name = queries[i], names[i]
        if like[i] >= 1.0 - allowed[i]:
            out[i] = max(out[i], 0.68 + 0.20 * like[i] + 0.12 * min(len(q), len(name)) / max(len(q), len(name)))
    return out


def abbreviation(plain: Column, compact: Column) -> Column:
    """The family name behind its abbreviations, or null."""
    hit = compact.isin(*KINGS_CROSS) | plain.isin("king s", "kings x", "king x", "k x") | plain.rlike(r"\b(?:kings?\s*x|kx|kings?\s+cross)\b") | (plain.contains("pancras") & plain.rlike(r"\bkings?\b"))
    return F.when(hit, KINGS_CROSS_NAME)
