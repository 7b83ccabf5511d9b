"""Plain answers to the operators' questions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

GAP = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated(docs, units, window):
    """Per row: flags of the units covered by a window that an earlier document has."""
    earliest = {}
    for doc, seq in zip(docs, units, strict=True):
        if doc is not None:
            for i in range(len(seq) - window + 1):
                key = tuple(seq[i : i + window]) if isinstance(seq, list) else seq[i : i + window]
                earliest[key] = min(doc, earliest.get(key, doc))
    out = []
    for doc, seq in zip(docs, units, strict=True):
        gone = bytearray(len(seq))
        if doc is not None:
            for i in range(len(seq) - window + 1):
                key = tuple(seq[i : i + window]) if isinstance(seq, list) else seq[i : i + window]
                if earliest[key] < doc:
                    gone[i : i + window] = b"\1" * window
        out.append(gone)
    return out


def op5(rows):
    docs, texts = [r[0] for r in rows], [(r[1] or "").encode() for r in rows]
    out = []
    for doc, text, gone in zip(docs, texts, repeated(docs, texts, 50), strict=True):
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(text), sum(gone), spans, sha(bytes(b for b, g in zip(text, gone, strict=True) if not g))))
    return out


def op10(rows):
    docs, words = [r[0] for r in rows], [WORD.findall(r[1] or "") for r in rows]
    out = []
    for doc, seq, gone in zip(docs, words, repeated(docs, words, 13), strict=True):
        out.append((doc, len(seq), sum(gone), sha(" ".join(w for w, g in zip(seq, gone, strict=True) if not g).encode())))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset([tuple(words)])


def op9(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and None not in (rows[i][0], rows[j][0]):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return [(r[0], len(s), None if r[0] is None else root(r[0]), None if r[0] is None else root(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)]


def lower_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def simhash(text, size):
    words = lower_words(text)
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op11(rows, size=3, bits=2):
    prints = [simhash(r[1], size) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= bits and None not in (rows[i][0], rows[j][0]):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return [(r[0], f"{x:016x}", None if r[0] is None else root(r[0])) for r, x in zip(rows, prints, strict=True)]


def op12(rows, dims=64, scale=64, k=16, rounds=3, seed=1):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v, [math.floor(Fraction(x) * scale) for x in v]) for i, v in kept]
    start = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}".encode()), r[1]))[:k]
    centres = [r[2] for r in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centres)]
    found = [(i, *reversed(nearest(v))) for i, _, v in kept]
    part = defaultdict(int)
    for _, n, d in found:
        part[n] += d
    fits = lambda x: x if x < 1 << 63 else None
    bad = {n for _, n, d in found if fits(d) is None}
    return [
        (i, n, fits(d), None if n in bad else fits(part[n]), None if bad else fits(sum(part.values())), sha(",".join(map(str, centres[n])).encode()))
        for i, n, d in found
    ]


def op13(rows, target, max_words=1, buckets=10_000, percent=10, least=20, seed=2024):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(words[i : i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)

    docs, wanted = [features(r[1]) for r in rows], [features(t) for t in target]
    s, t = Counter(), Counter()
    for _, c in docs:
        s.update(c)
    for _, c in wanted:
        t.update(c)
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (doc, _), (n_words, c) in zip(rows, docs, strict=True):
        weight = sum(gain(b) * n for b, n in c.items())
        h = int(sha(f"{seed}:{'' if doc is None else doc}".encode())[:8], 16)
        out.append([doc, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]
