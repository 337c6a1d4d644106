"""The best names of many typed texts: a block of texts of one length against a block of names of one length, in numpy.

Scores are those of ``fuzzy.alias_score``, by its ways: edits of the whole name, edits of
windows at a longer name's ends, letters in order.  Texts are compact forms (a-z, 0-9).  Each text brings a
floor, below which no score is asked for: it says how many edits are of use, and a pair whose
letters alone differ by more is not compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from . import fuzzy

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
CODES = np.full(256, 255, np.uint8)
CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))
#: Pairs that are looked at together, so that they stay in a core's cache; and letters of names that have a table of next places.
PAIRS, PLACES = 1 << 18, 1 << 19
#: Pairs whose edits are counted together.
AT_ONCE = 1 << 15
#: Numbers of the ways.
WHOLE, WINDOWS, IN_ORDER = range(3)
#: Floors are compared with this much to spare.
SPARE = 1e-9


def spelt(texts: str, size: int) -> np.ndarray:
    """A row of codes for each text of a size; the texts follow each other."""
    codes = CODES[np.frombuffer(texts.encode("ascii"), np.uint8)].reshape(-1, size)
    if codes.size and codes.max() == 255:
        raise ValueError("compact forms have letters a-z and digits only")
    return codes


def letters_of(columns: np.ndarray) -> np.ndarray:
    """Bits of the letters that a text has, and of those that it has twice; a row of ``columns`` for each letter."""
    for bits in beginnings(columns):
        pass
    return bits


def beginnings(columns: np.ndarray) -> Iterator[np.ndarray]:
    """``letters_of`` of no letter, of the first one, of the first two, ..."""
    seen, twice = np.zeros((2, columns.shape[1]), np.uint64)
    yield seen.copy()
    for codes in columns:
        bit = np.uint64(1) << codes.astype(np.uint64)
        twice |= seen & bit
        seen |= bit
        yield seen | (twice & np.uint64((1 << 26) - 1)) << np.uint64(len(LETTERS))


def places_of(codes: np.ndarray) -> np.ndarray:
    """For each text and letter the bits of its places in the text, of up to 64 letters, in the narrowest type that holds them."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if codes.shape[1] <= np.iinfo(t).bits)
    out = np.zeros((len(codes), len(LETTERS)), kind)
    for j in range(codes.shape[1]):
        out[np.arange(len(codes)), codes[:, j]] |= kind(1 << j)
    return out


def edits(places: np.ndarray, at: np.ndarray, codes: np.ndarray, size: int, ends: Sequence[int], skip: int = 0) -> list[np.ndarray]:
    """``fuzzy.edits`` of texts (rows ``at`` of their places, all of one size) and beginnings of names, for each end: a column of the table at a time, its steps as bits.

    ``codes``: a row for each letter of the names.  Up to ``skip`` letters at a name's beginning may
    be passed over, so that what is found is no more than the edits from any of these places on.
    """
    kind = places.dtype.type
    one, top = kind(1), kind(size - 1)
    up, down, same, last = np.full(len(at), ~kind(0)), *np.zeros((3, len(at)), kind)
    now, out = np.full(len(at), size, np.int16), []
    every, row = places.ravel(), at * len(LETTERS)
    for j in range(ends[-1]):
        here = every[row + codes[j]]
        same = (((here & up) + up) ^ up) | here | down | (((~same & here) << one) & last)
        more, less = down | ~(same | up), same & up
        now = now + ((more >> top) & one).astype(np.int16) - ((less >> top) & one).astype(np.int16)
        more, less = (more << one) | kind(j >= skip), less << one
        up, down, last = less | ~(same | more), more & same, here
        if j + 1 in ends:
            out.append(now)
    return out


def edit_scores(size: int, length: int, window: int) -> np.ndarray:
    """The scores of 0, 1, ... edits that may count, of a text and a window of a name (or all of it)."""
    longest, out = max(size, window), []
    least = 1.0 - fuzzy.allowed_edits(max(size, min(length, size + 1))) / size
    while (like := 1.0 - len(out) / longest) >= max(least, 0.0):
        out.append(0.68 + 0.20 * like + 0.12 * min(size, length) / max(size, length))
    return np.array(out)


def ends_of(size: int) -> list[int]:
    """The sizes of ``fuzzy.windows``, which start at the first three places, or end at the last three."""
    return sorted({max(3, size - 1), size, size + 1})


def _missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & ~b)


def _next_places(codes: np.ndarray) -> np.ndarray:
    """name, place, letter: where the letter stands at or after the place; the name's length where it doesn't."""
    n, size = codes.shape
    out = np.full((n, size + 2, len(LETTERS)), size, np.int32 if size > 32_000 else np.int16)
    for j in range(size - 1, -1, -1):
        out[:, j] = out[:, j + 1]
        out[np.arange(n), j, codes[:, j]] = j
    return out


class Names:
    """A block of names of one length. What texts of several sizes look at is made once."""

    def __init__(self, names: str, length: int) -> None:
        self.length, self.spelling, self.codes = length, [names[a : a + length] for a in range(0, len(names), length)], spelt(names, length)
        self.columns = [np.ascontiguousarray(self.codes.T)]
        self.columns.append(self.columns[0][::-1])
        self.steps = [beginnings(c) for c in self.columns]
        self.first: list[list[np.ndarray]] = [[], []]
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.spelling)

    def letters(self, back: bool, end: int) -> np.ndarray:
        """Letters before a place."""
        known = self.first[back]
        while len(known) <= min(end, self.length):
            known.append(next(self.steps[back]))
        return known[min(end, self.length)]

    def halves(self, back: bool, half: int, end: int, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters before and after a place, with some room on its other side."""
        return self.letters(back, half + room), letters_of(self.columns[back][max(0, half - room) : end])

    def part(self, a: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters and next places of n names from one on."""
        if a not in self.whole:
            self.whole[a] = letters_of(self.columns[0][:, a : a + n]), _next_places(self.codes[a : a + n])
        return self.whole[a]


class Asked:
    """Texts of one size, and the best names that each has met so far, which raise its floor.

    Names that stand equal with a text's n-th best are all held, as their order isn't known here.
    """

    def __init__(self, texts: str, size: int, floors: np.ndarray, n: int) -> None:
        self.size, self.texts, self.codes = size, [texts[a : a + size] for a in range(0, len(texts), size)], spelt(texts, size)
        self.floors, self.n = floors.astype(float), n
        columns = [self.codes.T, self.codes.T[::-1]]
        self.letters = [letters_of(c) for c in columns]
        self.halves = [(letters_of(c[: size // 2]), letters_of(c[size // 2 :])) for c in columns]
        self.places = [places_of(c.T) if size <= 64 else None for c in columns]
        self.top = np.full((len(floors), n), -np.inf)
        self.names: list[str] = []
        self.held: list[tuple[np.ndarray, ...]] = []

    def likely(self, length: int, way: int) -> bool:
        """Whether a name of a length may reach the least of the floors."""
        size, reach = self.size, self.floors.min() - SPARE
        if way == WHOLE:
            return size - 2 - size / 5 <= length <= size + 2
        if way == WINDOWS:
            return length > size + 2 and 0.88 + 0.12 * size / length - 0.20 / max(3, size + 1) >= reach
        return 3 <= size <= 8 and length >= size and 0.90 + 0.10 * size / length >= reach

    def meet(self, names: Names, ways: Sequence[int]) -> None:
        """Holds the n best of a block's names by some ways, a name once by its best score."""
        found: list[tuple[np.ndarray, ...]] = []
        for way in ways:
            for i, j, score in _in_order(self, names) if way == IN_ORDER else _by_edits(self, names, way):
                keep = score >= self.floors[i] - SPARE
                found.append((i[keep], j[keep], score[keep]))
                if sum(len(f[0]) for f in found) > PAIRS:
                    found = [_first(*map(np.concatenate, zip(*found, strict=True)), self.n)]
        if not found:
            return
        i, j, score = _first(*map(np.concatenate, zip(*found, strict=True)), self.n)
        self.held.append((i, np.arange(len(i)) + len(self.names), score))
        self.names += [names.spelling[k] for k in j.tolist()]
        # each text's scores stand together
        rows = np.unique(i)
        more = np.full((len(rows), self.n), -np.inf)
        more[np.searchsorted(rows, i), np.arange(len(i)) - np.searchsorted(i, i)] = score
        self.top[rows] = np.sort(np.concatenate([self.top[rows], more], axis=1), axis=1)[:, -self.n :]
        self.floors = np.maximum(self.floors, self.top[:, 0])
        if len(self.names) > max(PAIRS, 4 * self.n * len(self.texts)):
            self._forget()

    def _forget(self) -> None:
        """Drops names below the floors that have risen since."""
        i, at, score = map(np.concatenate, zip(*self.held, strict=True))
        keep = score >= self.floors[i] - SPARE
        self.names = [self.names[k] for k in at[keep].tolist()]
        self.held = [(i[keep], np.arange(len(self.names)), score[keep])]

    def best(self) -> Iterator[tuple[str, str, float]]:
        """text, name, score of all that may be among a text's n best."""
        if self.held:
            self._forget()
            i, at, score = self.held[0]
            for a, b, c in zip(i.tolist(), at.tolist(), score.tolist(), strict=True):
                yield self.texts[a], self.names[b], c


def _by_edits(asked: Asked, names: Names, way: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, name, score of pairs within the edits that a floor allows; windows that equal the text are left to containment.

    Windows of several sizes that start, or end, at one place are compared as one; those that end at one are read backwards.
    Those that start at several places are first compared as one with some letters passed over, which few pairs outlast.
    Letters that one side has and the other hasn't are edits, in all and in each half.
    """
    size, length = asked.size, names.length
    ends = [length] if way == WHOLE else ends_of(size)
    tables = [edit_scores(size, length, end) for end in ends]
    most = [(t[None] >= asked.floors[:, None] - SPARE).sum(axis=1) - 1 for t in tables]
    room = np.max(most, axis=0)
    bound = np.minimum(room, 255).astype(np.uint8)  # compared faster; texts have fewer bits
    rows = np.flatnonzero(room > 0)
    if not len(rows):
        return
    widest = int(room.max())
    both, counts, near = (np.empty(max(PAIRS, len(names)), t) for t in (np.uint64, np.uint8, bool))
    step = max(1, PAIRS // len(names))
    skip = 0 if way == WHOLE else 2
    until = range(ends[0], min(ends[-1] + skip, length) + 1)

    def exact(i: np.ndarray, j: np.ndarray, back: bool) -> Iterator[tuple[np.ndarray, ...]]:
        for b in range(0, len(i), AT_ONCE):
            u, v = i[b : b + AT_ONCE], j[b : b + AT_ONCE]
            for start in range(1 + skip):
                own = [k for k, end in enumerate(ends) if start + end <= length]
                if asked.places[back] is not None:
                    found = edits(asked.places[back], u, names.columns[back][start:, v], size, [ends[k] for k in own])
                else:
                    said, held = [[t[k][::-1] if back else t[k] for k in at] for t, at in ((asked.texts, u), (names.spelling, v))]
                    held = [h[start:] for h in held]
                    found = [fuzzy.edits_of_pairs(said, [h[: ends[k]] for h in held]) for k in own]
                for k, d in zip(own, found, strict=True):
                    keep = d <= most[k][u]
                    yield u[keep], v[keep], tables[k][d[keep]]

    for back in (False,) if way == WHOLE else (False, True):
        left: list[tuple[np.ndarray, ...]] = []
        letters, places, half = asked.letters[back], asked.places[back], asked.halves[back]
        wide = ~names.letters(back, ends[-1] + skip)
        other = names.halves(back, size // 2, ends[-1] + skip, widest + skip)
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            shape, n = (len(some), len(names)), len(some) * len(names)
            np.bitwise_and(letters[some][:, None], wide[None], out=both[:n].reshape(shape))
            np.bitwise_count(both[:n], out=counts[:n])
            np.less_equal(counts[:n].reshape(shape), bound[some][:, None], out=near[:n].reshape(shape))
            i, j = np.divmod(np.flatnonzero(near[:n]), len(names))
            i = some[i]
            keep = _missing(half[0][i], other[0][j]) + _missing(half[1][i], other[1][j]) <= room[i]
            i, j = i[keep], j[keep]
            if way == WHOLE:
                keep = _missing(names.letters(False, length)[j], letters[i]) <= room[i]
                i, j = i[keep], j[keep]
            if not skip or places is None:
                yield from exact(i, j, back)
                continue
            for b in range(0, len(i), AT_ONCE):
                u, v = i[b : b + AT_ONCE], j[b : b + AT_ONCE]
                keep = np.min(edits(places, u, names.columns[back][:, v], size, until, skip), axis=0) <= room[u]
                left.append((u[keep], v[keep]))
                if sum(len(h[0]) for h in left) > PAIRS:
                    yield from exact(*map(np.concatenate, zip(*left, strict=True)), back)
                    left = []
        if left:
            yield from exact(*map(np.concatenate, zip(*left, strict=True)), back)


def _in_order(asked: Asked, names: Names) -> Iterator[tuple[np.ndarray, ...]]:
    """text, name, score of pairs where the name has the text's letters in order."""
    size, length, floors = asked.size, names.length, asked.floors
    wanted = np.flatnonzero(0.70 + 0.20 + 0.10 * size / length >= floors - SPARE)
    cut = max(1, PLACES // length)
    for c in range(0, len(names) if len(wanted) else 0, cut):
        bits, following = names.part(c, cut)
        step = max(1, PAIRS // len(bits))
        both, near = np.empty((step, len(bits)), np.uint64), np.empty((step, len(bits)), bool)
        for a in range(0, len(wanted), step):
            rows = wanted[a : a + step]
            np.bitwise_and(asked.letters[0][rows][:, None], ~bits[None], out=both[: len(rows)])
            np.equal(both[: len(rows)], 0, out=near[: len(rows)])
            i, j = np.divmod(np.flatnonzero(near[: len(rows)]), len(bits))
            i = rows[i]
            first = at = following[j, 0, asked.codes[i, 0]]
            for k in range(1, size):
                at = following[j, at + 1, asked.codes[i, k]]
                if k % 2:
                    # a span of which so much is known already
                    least = at.astype(np.int64) - first + size - k
                    keep = (at < length) & (0.70 + 0.20 * size / least + 0.10 * size / length >= floors[i] - SPARE)
                    i, j, at, first = i[keep], j[keep], at[keep], first[keep]
            keep = at < length
            i, j, span = i[keep], j[keep], (at[keep].astype(np.int64) - first[keep]) + 1
            yield i, j + c, 0.70 + 0.20 * size / span + 0.10 * size / length


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Each text's n best names, of equal ones those that come first."""
    order = np.lexsort((-score, j, i))
    i, j, score = i[order], j[order], score[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, score = i[new], j[new], score[new]
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < n], j[rank < n], score[rank < n]


def best_of_blocks(asked: str, size: int, floors: np.ndarray, names: str, length: int, way: int, n: int) -> Iterator[tuple[str, str, float]]:
    """text, name, score of each text's n best names of a block by a way, if not below its floor."""
    texts = Asked(asked, size, floors, n)
    texts.meet(Names(names, length), (way,))
    return texts.best()
