"""Secrets in texts: patterns for known forms, and a linear-chain conditional random field for others.

Three patterns find base spans: an assignment to a word such as ``password`` (8 characters
and more), an access key id (16), a run of lower-case hexadecimal digits (32).  Matches are
leftmost and don't overlap within a kind; one that is too short is dropped, and the search
goes on after it.

The field tags each token as the begin of a secret, inside one, or outside.  A token's
features are its shape (classes of characters, length, entropy, turns between digits and
others), the words before and after it, what stands between them, and features of the whole
text.  It learns from the corpus itself: texts are drawn by hash, ``TEXTS`` with a base span
and as many without, and tokens inside base spans are its secrets.  Training steps see all of
a token, or not what stands around it, or not its very shape, or neither, by turns, so that no
keyword and no one form of secret is needed by itself.  Training is distributed: each group of
pieces takes a pass of gradient steps from the common weights, and the groups' weights are
averaged.  The sample is bounded; everything else looks at whole texts, all of them.

Decoding is Viterbi.  A token that is ordinary by more than any tags around it could make
up for is outside on every best path, so only the runs between such tokens are searched,
side by side.  The field's spans are added as kind ``tagged`` where they overlap no base
span.  A corpus without any base span has nothing to learn from: only base spans are looked for.

Null texts are empty.  Spans are in code points, the end exclusive, ordered by start and then
kind.  Equal texts have equal spans; copies count once in the sample.  Other columns pass
through; one named ``secrets`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .shared import Packed, drop_shared, write_shared
from .workers import map_batches

#: Texts with a base span that the field learns from, and as many without.
TEXTS = 1000
#: Pieces of a text that are kept for training: those with secrets first, then by hash; and the tokens of a piece.
PIECES, PIECE = 3, 48
GROUPS, PASSES, STEP, DECAY, BATCH = 6, 8, 0.25, 1e-5, 24
#: Moves and begins learn more slowly: what tells secrets from other tokens belongs to the tokens.
MOVE_STEP = 0.03
#: Weights for what a token has in common with others, as many for what tells it from them, and as many for what stands around it.
WEIGHTS = 1 << 14
GENERAL, SPECIAL, CONTEXT = range(3)
#: What a training step doesn't see, by turns.
HIDDEN = ((), (CONTEXT,), (SPECIAL,), (SPECIAL, CONTEXT))
OUT, BEGIN, IN = range(3)
#: Added to the score of BEGIN when texts are read: a secret that is missed costs more than a word that is marked.
LEAN = 4.0
#: Kinds of tokens whose scores a worker remembers.
REMEMBERED = 300_000

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "tagged")
BASE = KINDS[:3]
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: What a text must match to hold a base span.
ANY_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""
ANY_ACCESS, ANY_HEX = "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}"

TOKEN = re.compile(r"(\w+(?:[+/.-]+\w+)*)")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
Spans = list[tuple[int, int, int, int]]


def base_spans(text: str) -> Spans:
    """start, rank, end, and where the secret itself starts, of the base spans."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens(text: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """The tokens, the gaps before each and after the last, and where tokens start and end."""
    parts = TOKEN.split(text)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return parts[1::2], parts[::2], ends[:-1:2], ends[1::2]


def _bucket(n: int) -> int:
    return n if n < 5 else 5 if n < 8 else 6 if n < 12 else 7 if n < 16 else 8 if n < 20 else 9 if n < 32 else 10 if n < 48 else 11


def _class(c: str) -> str:
    return "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "+/._-" else "o"


def shape(word: str) -> str:
    """Classes of the characters, one for each run, of the first eight runs."""
    out = ""
    for c in word[:64]:
        if (k := _class(c)) != out[-1:]:
            out += k
    return out[:8]


def plain(word: str) -> str:
    """The case of a word of letters, in usual writing; none of other tokens."""
    if word.isalpha() and len(word) <= 16:
        return "a" if word.islower() else "Aa" if word.istitle() else "A" if word.isupper() else ""
    return ""


def general_features(word: str, case: str) -> list[str]:
    """What a token has in common with others of its sort. Sizes and such are stated as reached, so that what lies beyond all that was learnt counts as much."""
    n = len(word)
    if case:
        return [f"plain={case},{_bucket(n)}"]
    counts = Counter(word).values()
    entropy = sum(-c / n * math.log2(c / n) for c in counts)
    turns = sum(1 for x, y in zip(word, word[1:], strict=False) if x.isdigit() != y.isdigit())
    upper, lower, digit = (any(map(f, word)) for f in (str.isupper, str.islower, str.isdigit))
    found = ["other", f"letters={upper or lower}", f"digits={digit}", f"marks={not word.isalnum()}"]
    found += [f"size>={x}" for x in (4, 8, 12, 16, 20, 32, 48) if n >= x]
    found += [f"entropy>={x}" for x in (2, 2.5, 3, 3.5, 4) if entropy >= x]
    found += [f"turns>={x}" for x in (1, 2, 4, 6, 8) if turns >= x]
    return found


def special_features(word: str, case: str) -> list[str]:
    """What tells a token from others of its sort."""
    if case:
        return []
    size = _bucket(len(word))
    found = [f"shape={shape(word)}", f"mix={''.join(sorted(set(map(_class, word))))},{size}"]
    if set(word) <= set("0123456789abcdefABCDEF"):
        found.append(f"hex={size}")
    return found


def gap_features(before: str) -> list[str]:
    marks = "".join(sorted(set(before[:64]) & set("=:\"'\n,;(){}[]@#$")))
    return [f"gap={marks[:4]}", f"wide={min(len(before), 3)}"]


def file_features(text: str, n_tokens: int) -> list[str]:
    """What the whole text is like: its size, and how often marks of code and figures stand in it."""
    share = lambda marks: min(8, int(200 * sum(map(text.count, marks)) / (n_tokens + 1)) // 10)
    return [f"file-size={int(math.log2(n_tokens + 1))}", f"file-assign={share('=:')}", f"file-code={share('{};<>')}", f"file-quote={share(chr(34))}"]


def _general(name: str) -> int:
    return crc32(name.encode()) % WEIGHTS


def _special(name: str) -> int:
    return WEIGHTS + crc32(name.encode()) % WEIGHTS


def _context(name: str) -> int:
    return 2 * WEIGHTS + crc32(name.encode()) % WEIGHTS


#: Where a word counts: as itself, one before, two before, one after the token.
PLACES = (0x0, 0x5BD1, 0x9E37, 0x2C1B)


def word_hash(word: str, case: str) -> int:
    return crc32((word.lower() if case else shape(word)).encode())


def word_weight(hashed, place: int):
    """The index of a word's weight at a place, of its hash (an int or an array)."""
    return ((hashed ^ PLACES[place]) ^ (hashed >> 15)) % WEIGHTS + (2 * WEIGHTS if place else WEIGHTS)


def edge_weight(place: int) -> int:
    return _context(f"edge {place}")


def own_indexes(word: str) -> list[int]:
    case = plain(word)
    return [*map(_general, general_features(word, case)), *map(_special, special_features(word, case))]


def features_at(words: list[str], gaps: list[str], i: int, file: list[int]) -> list[int]:
    """Indexes of the weights of token i."""
    out = own_indexes(words[i])
    for place, j in ((0, i), (1, i - 1), (2, i - 2), (3, i + 1)):
        out.append(int(word_weight(word_hash(words[j], plain(words[j])), place)) if 0 <= j < len(words) else edge_weight(place))
    return out + [_context(f) for f in gap_features(gaps[i])] + [_context(f"next-{gap_features(gaps[i + 1])[0]}"), *file]


@dataclass
class Field:
    """weights (feature, tag), moves (tag before, tag) and begins (tag of a text's first token)."""

    weights: np.ndarray
    moves: np.ndarray
    begins: np.ndarray

    @classmethod
    def new(cls) -> Field:
        return cls(np.zeros((3 * WEIGHTS, 3)), np.zeros((3, 3)), np.zeros(3))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.moves.ravel(), self.begins])

    @classmethod
    def of(cls, flat: np.ndarray) -> Field:
        n = 9 * WEIGHTS
        return cls(flat[:n].reshape(-1, 3), flat[n : n + 9].reshape(3, 3), flat[n + 9 :])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(scores: np.ndarray, field: Field, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces (piece, token, tag), padded to one size: each token's tag probabilities, the expected number of moves, and log partition sums."""
    m, width, _ = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + field.begins
    for t in range(1, width):
        live = (sizes > t)[:, None]
        forward[:, t] = np.where(live, _log_sum(forward[:, t - 1, :, None] + field.moves, 1) + scores[:, t], forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        live = (sizes > t + 1)[:, None]
        backward[:, t] = np.where(live, _log_sum(field.moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0.0)
    total = _log_sum(forward[np.arange(m), sizes - 1], 1)
    inside = np.arange(width) < sizes[:, None]
    tags = np.where(inside[..., None], np.exp(forward + backward - total[:, None, None]), 0.0)
    pairs = np.exp(forward[:, :-1, :, None] + field.moves + (scores + backward)[:, 1:, None, :] - total[:, None, None, None])
    moves = np.where(inside[:, 1:, None, None], pairs, 0.0).sum(axis=(0, 1))
    return tags, moves, total


def token_scores(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[ids], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)


def gradient(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]], field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of pieces (feature indexes, their number by token, tags, whether the text starts here): the weights' indexes and gradient, that of moves and begins, and the log-likelihood."""
    sizes = np.array([len(p[2]) for p in pieces])
    ids, counts, gold = (np.concatenate([p[i] for p in pieces]) for i in range(3))
    width = int(sizes.max())
    at = np.repeat(np.arange(len(pieces)), sizes), np.concatenate([np.arange(n) for n in sizes])
    starts = np.array([p[3] for p in pieces])
    flat = token_scores(ids, counts, field.weights)
    scores = np.zeros((len(pieces), width, 3))
    scores[at] = flat
    scores[~starts, 0] -= field.begins  # what precedes a piece from the middle isn't known
    tags, moves, total = marginals(scores, field, sizes)
    truth = np.eye(3)[gold]
    wrong = truth - tags[at]
    where, spread = np.unique(ids, return_inverse=True)
    each = np.repeat(wrong, counts, axis=0)
    steps = np.stack([np.bincount(spread, each[:, y], len(where)) for y in range(3)], axis=1)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = np.ones(len(gold), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((3, 3))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1.0)
    begins = (truth[first] - tags[:, 0])[starts].sum(axis=0)
    own = (flat * truth).sum() + (field.moves * seen).sum() + field.begins[gold[first[starts]]].sum() - total.sum()
    return where, steps, seen - moves, begins, float(own)


def has_base(text: Column) -> Column:
    """Whether a text may hold a base span. Patterns are looked for only where their words stand."""
    lower = F.lower(text)
    word = reduce(lambda x, y: x | y, [lower.contains(k) for k in KEYWORDS])
    return (word & text.rlike(ANY_ASSIGN)) | (text.contains("AKIA") & text.rlike(ANY_ACCESS)) | text.rlike(ANY_HEX)


def _pieces(text: str, key: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Training pieces of a text: order, feature indexes, their numbers, tags, whether the text starts there."""
    words, gaps, starts, ends = tokens(text)
    tags = np.zeros(len(words), np.int8)
    for _, _, end, start in base_spans(text):
        inside = np.flatnonzero((starts < end) & (ends > start))
        tags[inside] = IN
        tags[inside[:1]] = BEGIN
    cuts = range(0, len(words), PIECE)
    chosen = sorted(cuts, key=lambda a: (not tags[a : a + PIECE].any(), crc32(f"{key}:{a}".encode())))[:PIECES]
    file = [_context(f) for f in file_features(text, len(words))]
    out = []
    for a in chosen:
        found = [features_at(words, gaps, i, file) for i in range(a, min(a + PIECE, len(words)))]
        out.append((a, np.array([x for f in found for x in f], np.int32), np.array([len(f) for f in found], np.int32), tags[a : a + PIECE], a == 0))
    return out


PIECE_SCHEMA = "grp int, key long, place long, ids binary, counts binary, tags binary"


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(abs(k) % GROUPS, k, a, ids.tobytes(), counts.tobytes(), tags.tobytes()) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) for a, ids, counts, tags, _ in _pieces(t, k)]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["grp", "key", "place", "ids", "counts", "tags"])


def _pass(flat: np.ndarray, number: int) -> Callable[[pa.Table], pa.Table]:
    """A pass of gradient steps over a group's pieces, in their order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("place", "ascending")])
        pieces = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32), np.frombuffer(r["tags"], np.int8).astype(np.int64), r["place"] == 0) for r in table.to_pylist()]
        field = Field.of(flat.copy())
        squares, move_squares, begin_squares = np.full(field.weights.shape, 0.1), np.full((3, 3), 0.1), np.full(3, 0.1)
        order = np.random.default_rng(number).permutation(len(pieces))
        for b in range(0, len(order), BATCH):
            batch = [pieces[i] for i in order[b : b + BATCH]]
            if hidden := HIDDEN[(b // BATCH + number) % len(HIDDEN)]:
                batch = [(ids[seen], np.add.reduceat(seen.astype(np.int32), np.concatenate([[0], np.cumsum(counts)[:-1]])), tags, starts) for ids, counts, tags, starts in batch for seen in [~np.isin(ids // WEIGHTS, hidden)]]
            where, steps, moves, begins, _ = gradient(batch, field)
            steps = steps - DECAY * len(batch) * field.weights[where]
            squares[where] += steps**2
            field.weights[where] += STEP * steps / np.sqrt(squares[where])
            for value, slope, square in ((field.moves, moves, move_squares), (field.begins, begins, begin_squares)):
                slope = slope - DECAY * len(batch) * value
                square += slope**2
                value += MOVE_STEP * slope / np.sqrt(square)
        return pa.table({"grp": table.column("grp").slice(0, 1), "weights": pa.array([field.flat().tobytes()], pa.binary())})

    return run


def fit(docs: DataFrame, *, text: str = "text", texts: int = TEXTS, passes: int = PASSES) -> Field | None:
    """The field learnt from a sample of the corpus; none if no text of the corpus has a base span."""
    body = docs.select(F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null").withColumn("key", F.xxhash64("text"))
    known, known_path = write_shared(body.select("key", has_base(F.col("text")).alias("has")).distinct(), "keys")
    bounds = {}
    for has in (True, False):
        least = known.filter(F.col("has") == has).orderBy("key").limit(texts).agg(F.max("key")).first()[0]
        if least is not None:
            bounds[has] = least
    drop_shared(docs.sparkSession, known_path)
    if True not in bounds:
        return None
    cut = lambda has: (F.col("key") <= bounds[has]) if has in bounds else F.lit(False)
    chosen = body.filter(cut(True) | cut(False)).withColumn("has", has_base(F.col("text"))).filter((F.col("has") & cut(True)) | (~F.col("has") & cut(False)))
    pieces, path = write_shared(map_batches(chosen.groupBy("key").agg(F.first("text").alias("text")), _training, PIECE_SCHEMA), "pieces")
    flat = Field.new().flat()
    for number in range(passes):
        done = pieces.groupBy("grp").applyInArrow(_pass(flat, number), "grp int, weights binary").orderBy("grp").collect()  # GROUPS rows of the model's size
        flat = np.mean([np.frombuffer(r["weights"]) for r in done], axis=0)
    drop_shared(docs.sparkSession, path)
    return Field.of(flat)


def slack(field: Field) -> float:
    """What changing one tag to OUT can cost at most in moves to it and from it."""
    before = np.vstack([field.moves, field.begins])
    after = np.column_stack([field.moves, np.zeros(3)])
    return float(max((before[:, y] - before[:, OUT]).max() + (after[y] - after[OUT]).max() for y in (BEGIN, IN)))


def viterbi(scores: np.ndarray, field: Field, firsts: np.ndarray, cut: float | None = None) -> np.ndarray:
    """Best tags of the tokens of texts laid end to end; ``firsts``: whether a token is its text's first."""
    n = len(scores)
    tags = np.zeros(n, np.int8)
    open_ = scores[:, OUT] - scores[:, 1:].max(axis=1) <= (slack(field) if cut is None else cut)
    if not open_.any():
        return tags
    begins = open_ & (firsts | ~np.concatenate([[False], open_[:-1]]))
    starts = np.flatnonzero(begins)
    after = np.concatenate([firsts[1:], [True]])  # the next token is another text's
    stops = np.flatnonzero(open_ & (after | ~np.concatenate([open_[1:], [False]])))
    sizes = stops - starts + 1
    order = np.argsort(-sizes, kind="stable")
    starts, stops, sizes = starts[order], stops[order], sizes[order]
    score = scores[starts] + np.where(firsts[starts][:, None], field.begins, field.moves[OUT])
    back = []
    for t in range(1, int(sizes[0])):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        ways = score[:k, :, None] + field.moves
        best = ways.argmax(axis=1)
        back.append(best.astype(np.int8))
        score[:k] = np.take_along_axis(ways, best[:, None], axis=1)[:, 0] + scores[starts[:k] + t]
    score = score + np.where(after[stops][:, None], 0.0, field.moves[:, OUT])
    tag = score.argmax(axis=1).astype(np.int8)
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        tags[starts[:k] + t] = tag[:k]
        if t:
            tag[:k] = np.take_along_axis(back[t - 1], tag[:k, None].astype(np.int64), axis=1)[:, 0]
    return tags


class Scorer:
    """Scores of tokens; what a kind of token adds as itself and at its neighbours is remembered."""

    def __init__(self, field: Field, lean: float = LEAN):
        self.field, self.lean = field, lean
        self.cases: dict[tuple[str, int], np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        w = self.field.weights
        self.numbers: dict[str, int] = {}
        self.rows = np.stack([np.stack([np.zeros(3), *(w[edge_weight(p)] for p in (1, 2, 3))])])
        self.gaps: dict[str, int] = {}
        self.gap_rows = np.zeros((0, 2, 3))

    def learn(self, words: set[str]) -> None:
        """Remember what these words add: as itself, and at one before, two before, one after the token."""
        w = self.field.weights
        new = [x for x in words if x not in self.numbers]
        if not new:
            return
        hashes, own = np.empty(len(new), np.int64), np.empty((len(new), 3))
        known = self.cases
        for i, x in enumerate(new):
            case = plain(x)
            if not case:
                hashes[i], own[i] = crc32(shape(x).encode()), w[own_indexes(x)].sum(axis=0)
                continue
            hashes[i], size = crc32(x.lower().encode()), len(x)
            if (case, size) not in known:
                known[case, size] = w[own_indexes(x)].sum(axis=0)
            own[i] = known[case, size]
        near = np.stack([w[word_weight(hashes, p)] for p in range(4)], axis=1)
        near[:, 0] += own
        self.numbers.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, near])

    def learn_gaps(self, gaps: set[str]) -> None:
        w = self.field.weights
        new = [x for x in gaps if x not in self.gaps]
        if new:
            both = [[w[[_context(f) for f in found]].sum(axis=0), w[_context(f"next-{found[0]}")]] for found in map(gap_features, new)]
            self.gaps.update(zip(new, range(len(self.gap_rows), len(self.gap_rows) + len(new)), strict=True))
            self.gap_rows = np.concatenate([self.gap_rows, np.array(both)])

    def scores(self, texts: list[tuple[list[str], list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts (words, gaps, file features) laid end to end: the tokens' scores, and which are first."""
        if len(self.rows) + len(self.gap_rows) > REMEMBERED:
            self.forget()
        self.learn(set().union(*(words for words, _, _ in texts)))
        self.learn_gaps(set().union(*(between for _, between, _ in texts)))
        sizes = np.array([len(words) for words, _, _ in texts])
        numbers, gaps = self.numbers, self.gaps
        ids, befores, afters = [], [], []
        for words, between, _ in texts:
            found = [gaps[x] for x in between]
            ids += [0, 0, *[numbers[x] for x in words], 0]
            befores += found[:-1]
            afters += found[1:]
        ids = np.array(ids, np.int64)
        own = np.ones(len(ids), bool)
        heads = np.cumsum(sizes + 3) - sizes - 3
        own[heads] = own[heads + 1] = own[heads + sizes + 2] = False
        at = np.flatnonzero(own)
        total = self.rows[ids[at], 0] + self.rows[ids[at - 1], 1] + self.rows[ids[at - 2], 2] + self.rows[ids[at + 1], 3]
        if len(at):
            file = np.stack([self.field.weights[[_context(f) for f in found]].sum(axis=0) for _, _, found in texts])
            total += self.gap_rows[befores, 0] + self.gap_rows[afters, 1] + np.repeat(file, sizes, axis=0)
        total[:, BEGIN] += self.lean
        firsts = np.zeros(len(at), bool)
        firsts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return total, firsts


def tagged_spans(tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Where secrets start and end, from the tags of one text."""
    out: list[tuple[int, int]] = []
    inside = np.flatnonzero(tags)
    for i in inside.tolist():
        if tags[i] == IN and out and i and tags[i - 1] != OUT:
            out[-1] = out[-1][0], int(ends[i])
        else:
            out.append((int(starts[i]), int(ends[i])))
    return out


def scan(texts: list[str], scorer: Scorer | None) -> list[list[dict]]:
    """All spans of each text."""
    found = [base_spans(t) for t in texts]
    extra: list[list[tuple[int, int]]] = [[] for _ in texts]
    if scorer:
        cut = [tokens(t) for t in texts]
        scores, firsts = scorer.scores([(words, gaps, file_features(t, len(words))) for t, (words, gaps, _, _) in zip(texts, cut, strict=True)])
        tags = viterbi(scores, scorer.field, firsts)
        at = 0
        for i, (words, _, starts, ends) in enumerate(cut):
            own = tags[at : at + len(words)]
            at += len(words)
            if own.any():
                extra[i] = [(a, b) for a, b in tagged_spans(own, starts, ends) if not any(s < b and a < e for s, _, e, _ in found[i])]
    return [[{"start": a, "rank": r, "kind": KINDS[r], "end": b} for a, r, b in sorted([(s, r, e) for s, r, e, _ in base] + [(a, 3, b) for a, b in more])] for base, more in zip(found, extra, strict=True)]


def find_secrets(docs: DataFrame, *, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with ``secrets``: its spans (start, rank, kind, end); the field is learnt from ``docs`` unless one is given."""
    field = fit(docs, text=text) if field is None else field
    packed = Packed(docs)
    own = packed.rows.select("row", F.coalesce(packed.field(text).cast("string"), F.lit("")).alias("text"))
    schema = StructType([own.schema["row"], StructField("secrets", DataType.fromDDL(SPAN))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field) if field else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scan(batch.column("text").to_pylist(), scorer), kind)], names=["row", "secrets"])

    return packed.unpack_with(map_batches(own, run, schema), secrets=F.col("secrets"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")


def base_only() -> Column:
    return F.filter("secrets", lambda x: x["rank"] < len(BASE))
