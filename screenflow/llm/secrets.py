"""Secret scans with a battery of randomness tests.

Fixed patterns find assigned passwords, access keys and hexadecimal strings.
All other runs of encoded characters, of any length, are tests in the smallest
alphabet that fits them (hexadecimal, base32, base36, base64; a token of one case
without its separators). Numbers are none. A token is a secret if

* the battery does not tell it from uniform draws of its alphabet: chi-squared
  over the alphabet, runs (above and below its middle, and of digits among letters),
  serial correlation (of neighbours, and of equal symbols some places apart), with
  the smallest of the p-values corrected for their number, and
* its symbols and its changes between capitals, small letters and digits, which
  the battery reads against uniform draws, don't fit an ordinary token. Each
  encoding has null models of ordinary tokens: how often they have each symbol and
  how often they change class, as words and numbers do, as names in camel case do,
  or as part numbers do, whose groups repeat a pattern. A token's p-value is the
  inverse of the likelihood ratio of uniform draws to the model that fits it best, which
  bounds the chance that an ordinary token of any of these kinds looks as uniform, at every
  length. These p-values go through
  Benjamini-Hochberg false-discovery control over all documents, separately for
  each doubling of length, as short tokens carry less evidence than long ones.

The control needs the counts of binned p-values alone: at most 32 lengths times
256 bins reach the driver, whatever the size of the input. Tokens whose p-value
is above the share of false discoveries can't be found at any count; they are
only counted.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.llm.common import col, free_name, stored

#: The kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]+={0,2}")
#: Words of which an assignment holds one, in lower case.
NAMES = ("password", "passwd", "secret", "token", "api")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: The null models, in thousandths: how often ordinary tokens have a letter (English, German, French and Spanish
#: prose) and a digit, how often they change class, and the share of symbols that follow no such habit.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (80, 17, 30, 43, 140, 15, 18, 40, 72, 4, 8, 45, 26, 77, 58, 24, 6, 66, 70, 72, 45, 13, 12, 3, 8, 8), strict=True))
DIGITS = dict(zip("0123456789", (220, 180, 150, 80, 70, 70, 60, 50, 50, 70), strict=True))
CHANGES = {"hex": 150, "base32": 100, "base36": 100, "base64": 250}
NO_HABIT = 100
#: How often classes (digits, capitals, small letters, the rest) follow a change, against each other.
CLASS_WEIGHTS = (30, 30, 60, 20)
#: Camel case, in thousandths: the class (in the same order) that follows a class.
CAMEL = ((600, 200, 150, 50), (15, 50, 925, 10), (20, 240, 730, 10), (50, 350, 550, 50))
#: Part numbers: how often a group repeats the pattern of the one before, in thousandths; the most symbols of a group.
SAME_PATTERN, GROUP = 800, 4
#: Symbols are compared with those up to so many places before.
LAGS = 16
#: A candidate below this battery p-value is not random; the share of false discoveries allowed.
BATTERY_LEVEL, FALSE_SHARE = 0.001, 0.01
BINS = 256
SEPARATORS = str.maketrans("", "", "+/_-")
HEX_DIGITS, BASE32 = frozenset("0123456789ABCDEF"), frozenset(ALPHABETS["base32"])
PLACES = {kind: {c: i for i, c in enumerate(alphabet)} for kind, alphabet in ALPHABETS.items()}
#: Tokens up to this length are judged once, as long as there are not too many of them.
REMEMBERED, MOST_REMEMBERED = 64, 200_000
SPAN = "struct<kind:string,start:bigint,end:bigint>"
FOUND = f"base array<{SPAN}>, candidates array<struct<start:bigint,end:bigint,octave:int,bin:int>>, tests array<struct<octave:int,bin:int,n:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, as (kind, start, end) in code points."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def encoding(token: str) -> tuple[str, str] | None:
    """The smallest alphabet that a token fits, and the token in it; None for numbers and separators."""
    upper, lower = token.upper(), token.lower()
    if token in (upper, lower):
        plain = upper.translate(SEPARATORS)
        if not plain or plain.isdigit():
            return None
        if HEX_DIGITS.issuperset(plain):
            return "hex", plain.lower()
        return ("base32" if BASE32.issuperset(plain) else "base36"), plain
    return "base64", token.replace("-", "+").replace("_", "/")


def upper_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def battery(codes: np.ndarray, size: int) -> float:
    """How well uniform draws from ``size`` symbols explain the codes: the corrected least p-value."""
    n = len(codes)
    bins = min(size, 1 << max(2, int(math.log2(n / 5))))
    counts = np.bincount(codes * bins // size, minlength=bins)
    chi = float(((counts - n / bins) ** 2).sum() * bins / n)
    free = bins - 1
    shape = 2 / (9 * free)
    p_chi = upper_tail(((chi / free) ** (1 / 3) - 1 + shape) / math.sqrt(shape))
    high = codes * 2 >= size
    n1, n0 = int(high.sum()), int(n - high.sum())
    if n1 and n0:
        mean = 2 * n0 * n1 / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = 2 * upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    else:
        p_runs = 2.0 ** (1 - n)
    centred = codes - codes.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * upper_tail(abs(serial + 1 / n) * math.sqrt(n))
    # Of the places compared at each lag, as many as chance allows are equal.
    lags = range(1, min(LAGS, n // 2) + 1)
    p_lags = min((at_least(int((codes[k:] == codes[:-k]).sum()), n - k, 1 / size) for k in lags), default=1.0) * max(len(lags), 1)
    return min(1.0, 4 * min(p_chi, p_runs, p_serial, p_lags))


def at_least(hits: int, trials: int, chance: float) -> float:
    """The chance of as many hits or more in independent trials."""
    if hits == 0:
        return 1.0
    return min(1.0, sum(math.comb(trials, i) * chance**i * (1 - chance) ** (trials - i) for i in range(hits, min(trials, hits + 60) + 1)))


def pattern_runs(plain: str) -> float:
    """The p-value of the runs of digits among the other symbols, given how many there are."""
    digit = np.frombuffer(plain.encode(), np.uint8) < 58
    n, n1 = len(digit), int(digit.sum())
    n0 = n - n1
    if n < 12 or min(n0, n1) < 4:
        return 1.0
    mean = 2 * n0 * n1 / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    return min(1.0, 2 * upper_tail((abs(1 + int((digit[1:] != digit[:-1]).sum()) - mean) - 0.5) / spread))


def symbol_class(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3


def null_model(kind: str, follows: tuple[tuple[int, ...], ...] | None = None) -> dict[str, float]:
    """Log-likelihood ratios of uniform draws to ordinary tokens: of a first symbol, and of a symbol after another.

    ``follows`` has the weight of each class after another; without it, classes change at the encoding's rate.
    """
    alphabet = ALPHABETS[kind]
    # Ordinary tokens in capitals may have any digit, also those that base32 leaves out.
    symbols = sorted({*alphabet, *DIGITS})
    classes = sorted({symbol_class(c) for c in alphabet})
    within = {}
    for k in classes:
        members = [c for c in symbols if symbol_class(c) == k]
        weight = {c: DIGITS.get(c) or LETTERS.get(c.lower(), 1) for c in members}
        total = sum(weight.values())
        within |= {c: (1 - NO_HABIT / 1000) * weight[c] / total + NO_HABIT / 1000 / len(members) for c in members}
    change, every = CHANGES[kind] / 1000, sum(CLASS_WEIGHTS[k] for k in classes)
    out = {}
    for c in alphabet:
        k = symbol_class(c)
        out[c] = -math.log(len(alphabet) * within[c] * CLASS_WEIGHTS[k] / every)
        for before in alphabet:
            j = symbol_class(before)
            if follows:
                step = follows[j][k] / sum(follows[j])
            else:
                step = 1 - change if j == k else change * CLASS_WEIGHTS[k] / (every - CLASS_WEIGHTS[j])
            out[before + c] = -math.log(len(alphabet) * within[c] * step)
    return out


NULL_MODELS = {kind: [null_model(kind)] for kind in ALPHABETS}
NULL_MODELS["base64"].append(null_model("base64", CAMEL))


def part_number(token: str, kind: str) -> float:
    """The log-likelihood ratio of uniform draws to a part number: groups whose patterns of letters and digits repeat.

    Zero or less: at least as likely a part number. Tokens without three short groups are none.
    """
    groups = [g for g in re.split("[+/_-]", token) if g]
    if kind not in ("base32", "base36") or len(groups) < 3 or max(map(len, groups)) > GROUP:
        return math.inf
    size, ratio, last = len(ALPHABETS[kind]), 0.0, None
    for group in groups:
        pattern = [c.isdigit() for c in group]
        share = 0.5 ** len(group)
        if last is not None:
            share = SAME_PATTERN / 1000 * (pattern == last) + (1 - SAME_PATTERN / 1000) * share
        # Within their class the symbols of either are uniform.
        digits = sum(pattern)
        uniform = ((size - 26) / size) ** digits * (26 / size) ** (len(group) - digits)
        ratio += math.log(uniform / share)
        last = pattern
    return ratio


def ordinary(plain: str, kind: str, token: str = "") -> float:
    """A bound of the chance that an ordinary token of the encoding looks as uniform (Markov's inequality)."""
    pairs = list(map(str.__add__, plain, plain[1:]))
    ratios = [model[plain[0]] + sum(map(model.__getitem__, pairs)) for model in NULL_MODELS[kind]]
    return math.exp(-max(0.0, min(*ratios, part_number(token, kind))))


def judged(token: str) -> tuple[int, int] | None:
    """Octave of the length and bin of the p-value; None for a token that is no test.

    Tokens that imply an encoding but fail the battery count with a p-value of 1,
    and so do those that could not be found at any count.
    """
    token = token.rstrip("=")
    form = encoding(token)
    if form is None:
        return None
    kind, plain = form
    octave, p = min(31, len(plain).bit_length()), ordinary(plain, kind, token)
    if p > FALSE_SHARE:
        return octave, 0
    codes = np.array([PLACES[kind][c] for c in plain])
    level = min(battery(codes, len(ALPHABETS[kind])), 2 * pattern_runs(plain))
    return octave, p_bin(p) if level >= BATTERY_LEVEL else 0


_REMEMBERED: dict[str, tuple[int, int] | None] = {}


def recalled(token: str) -> tuple[int, int] | None:
    if len(token) > REMEMBERED:
        return judged(token)
    if token not in _REMEMBERED:
        if len(_REMEMBERED) >= MOST_REMEMBERED:
            _REMEMBERED.clear()
        _REMEMBERED[token] = judged(token)
    return _REMEMBERED[token]


def candidates(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Tokens outside the base spans: those that may be found (start, end, octave, bin), and all tests (octave, bin, number)."""
    found, tests, placed = [], Counter(), bool(base)
    if not base:
        for token, n in Counter(CANDIDATE.findall(text)).items():
            test = _REMEMBERED.get(token) or recalled(token)
            if test:
                tests[test] += n
                placed = placed or test[1] > 0
    if placed:
        tests.clear()
        spans = sorted((s, e) for _, s, e in base)
        starts, furthest = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
        for m in CANDIDATE.finditer(text):
            test = recalled(m[0])
            at = bisect_right(starts, m.start()) - 1
            if test is None or (at >= 0 and furthest[at] >= m.end()):
                continue
            tests[test] += 1
            if test[1]:
                found.append((m.start(), m.end(), *test))
    return found, [(*test, n) for test, n in tests.items()]


def p_bin(p: float) -> int:
    """Bins of a quarter of a power of two; a bin stands for its largest p-value."""
    return min(BINS - 1, int(-4 * math.log2(max(p, 1e-300))))


def cut_points(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> dict[int, int]:
    """For each octave the least bin whose tokens are discoveries (Benjamini-Hochberg on binned p-values)."""
    out = {}
    for octave in {o for o, _ in counts}:
        tests = sum(n for (o, _), n in counts.items() if o == octave)
        found = 0
        for b in range(BINS - 1, -1, -1):
            found += counts.get((octave, b), 0)
            if found and 2.0 ** (-b / 4) <= share * found / tests:
                out[octave] = b
    return out


def findings(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns with ``base`` spans, ``candidates`` and counted ``tests`` of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = [base_spans(t) for t in frame["body"]]
            more = [candidates(t, b) for t, b in zip(frame["body"], base, strict=True)]
            frame = frame.drop(columns="body")
            frame["base"], frame["candidates"], frame["tests"] = base, [found for found, _ in more], [tests for _, tests in more]
            yield frame

    wanted = docs.select(*(col(c) for c in carry), F.coalesce(col(text_col), F.lit("")).alias("body"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema if f.name != "body")
    return wanted.mapInPandas(run, fields + FOUND)


def false_discovery_cuts(found: DataFrame) -> dict[int, int]:
    """The cut point of each length octave, from the counts over all documents."""
    rows = found.select(F.inline("tests")).groupBy("octave", "bin").agg(F.sum("n").alias("n")).collect()
    return cut_points({(r["octave"], r["bin"]): r["n"] for r in rows})


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (kind, start, end in code points) of every row.

    Texts are read whole; null counts as empty and has no spans. Repeated rows
    each get their result, and each count as tests. An empty table gives an
    empty result; other columns are not looked at.
    """
    found = stored(findings(docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")), carry=("doc_id",)), "secrets")
    cuts = false_discovery_cuts(found)
    least = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)) if cuts else None
    keep = F.filter("candidates", lambda c: c["bin"] >= F.coalesce(F.element_at(least, c["octave"]), F.lit(BINS))) if cuts else F.filter("candidates", lambda c: F.lit(False))
    added = F.transform(keep, lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.concat("base", added)).alias("spans"))


def in_order(spans):
    """Spans by start, then by the order of the kinds."""
    place = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined_spans(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every covered stretch replaced by the kind of its first span."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of its texts replaced; null texts stay null.

    The texts are scanned twice, to count the tests and to replace, so that no
    text has to be joined back.
    """
    cuts = false_discovery_cuts(findings(docs, text_col))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(one)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        more = [("random", s, e) for s, e, octave, b in candidates(text, base)[0] if b >= cuts.get(octave, BINS)]
        return redacted(text, base + more) if base or more else text

    replace = F.pandas_udf(run, "string")
    name = free_name(docs, "clean")
    return docs.withColumn(name, replace(col(text_col))).select(*(col(name).alias(c) if c == text_col else col(c) for c in docs.columns))
