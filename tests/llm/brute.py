"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def contamination(docs, items, span=13):
    windows = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(span, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item) if item is not None else "null")
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                its = windows.get(tuple(words[k : k + n]))
                if its:
                    hit |= set(range(k, k + n))
                    found |= its
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def fingerprint(text, n=3, seed=42):
    words = NON_SPACE.findall(lower(text))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed)
        ones += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if shingles and 2 * ones[b] > len(shingles))


def components(ids, fps, radius=3):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                x, y = find(a), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def substrings(docs, window=50):
    """docs in order of id, ids unique."""
    first, out = {}, {}
    for doc, text in docs:
        words = NON_SPACE.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if first.setdefault(key, doc) < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def pii(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, valid) in enumerate(PII) for m in pattern.finditer(text or "") if valid(m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
