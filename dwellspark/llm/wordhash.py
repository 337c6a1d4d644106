"""Vectorised word splitting and hashing over the byte buffers of Arrow columns.

All functions work on one *chunk*: the UTF-8 bytes of several texts laid end to
end, with the offsets of the texts.  Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Texts are taken together until they hold so many bytes; bounds a task's memory.
CHUNK_BYTES = 1 << 18

U64 = np.uint64
#: Odd multipliers of the polynomial hashes and constants of the final mixing (fixed, arbitrary).
WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
GRAM_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words of letters, digits and everything beyond ASCII.
ALNUM_BYTES = byte_class(lambda b: b > 0x7F or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Words of everything but ASCII white space.
NON_SPACE_BYTES = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Lower-cases A-Z.
LOWER_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(MIX_1)
    h = (h ^ (h >> U64(29))) * U64(MIX_2)
    return h ^ (h >> U64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 12))
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (base, inverse))
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def forget_powers() -> None:
    _powers.clear()


class Chunk(NamedTuple):
    """Rows ``first`` to ``first + len(bounds) - 1`` of a batch; ``bounds``: each text's first word, and the end."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A field of the column ``row``, which holds whole rows."""
    return pa.compute.struct_field(batch.column("row"), name)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; nulls become empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def chunks(column: pa.Array, word_bytes: np.ndarray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into chunks of about ``limit`` bytes (a longer text is a chunk of its own)."""
    at, raw = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        data = raw[at[i] : at[j]]
        if lower:
            data = LOWER_BYTES[data]
        offsets = at[i : j + 1] - at[i]
        inside = word_bytes[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            breaks = np.zeros(len(data), bool)
            breaks[inner] = True
            first[1:] &= ~inside[:-1] | breaks[1:]
            last[:-1] &= ~inside[1:] | breaks[1:]
        starts = np.flatnonzero(first)
        yield Chunk(i, data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))
        i = j


def byte_sums(chunk: Chunk, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``sums`` and ``down``: (sums[b] - sums[a]) * down[a] depends on bytes a to b alone."""
    up, down = powers(WORD_BASES[which], len(chunk.data))
    sums = np.zeros(len(chunk.data) + 1, U64)
    np.cumsum((chunk.data.astype(U64) + U64(1)) * up[: len(chunk.data)], out=sums[1:])
    return sums, down


def word_hashes(chunk: Chunk, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sums, down = byte_sums(chunk, which)
    return mix((sums[chunk.ends] - sums[chunk.starts]) * down[chunk.starts])


def gram_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words, those that cross texts included."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = powers(GRAM_BASES[which], len(words))
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def inside_one_text(bounds: np.ndarray, n: int) -> np.ndarray:
    """Of all runs of n consecutive words, those that lie in one text."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total - n + 1, bool)
    sizes = np.diff(bounds)
    for back in range(1, n):
        at = bounds[1:][sizes > 0] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def owner(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text (within the chunk) that holds each word."""
    return np.searchsorted(bounds, at, side="right") - 1


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def cover(starts: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in any of the runs [start, start + length)."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def winnow(grams: np.ndarray, ok: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window of ``window`` consecutive runs in one text (all, if equal)."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = np.where(ok, grams, U64(0xFFFFFFFFFFFFFFFF))
    least = np.lib.stride_tricks.sliding_window_view(low, window)
    whole = np.convolve(ok.astype(np.int32), np.ones(window, np.int32), "valid") == window
    least = np.where(whole, least.min(axis=1), U64(0))
    # a run is kept if it equals the minimum of some whole window that holds it; that minimum is the largest of its windows'
    padded = np.concatenate([np.zeros(window - 1, U64), least, np.zeros(window - 1, U64)])
    most = np.lib.stride_tricks.sliding_window_view(padded, window).max(axis=1)
    in_whole = np.convolve(whole.astype(np.int32), np.ones(window, np.int32), "full")[: len(grams)] > 0
    return np.flatnonzero(ok & in_whole & (low == most))
