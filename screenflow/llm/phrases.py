"""Substring dedup by repeated-phrase automata.

Passages of 13 words that recur in another document, by their hash, are compiled into
Aho-Corasick automata, sharded by the anchors of the passages. The stretches of every
document that hold a shared anchor stream through the automata of its shard, which
locate all occurrences, word for word: they confirm a passage, tell its earliest
document, and give all places in later ones. Words that those cover go.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from screenflow.llm.anchors import Rule, covered, earlier_windows, own_hits
from screenflow.llm.common import mixed

#: Consecutive words of a passage.
WORDS = 13
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A word's bytes are hashed by their places in blocks of this size, and its blocks by their numbers.
BLOCK = 256
_POWERS = np.multiply.accumulate(np.full(BLOCK, 0x9E3779B97F4A7C15, np.uint64))
_BLOCK_STEP = np.uint64(0xD1B54A32D192ED03)
_IS_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SPANS = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


def word_units(data: np.ndarray, offsets: np.ndarray):
    """Each run of bytes other than white space is a unit; rows end words too."""
    word = ~_IS_GAP[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), first, last
    owner = np.cumsum(begins) - 1
    place = np.arange(len(data)) - first[np.maximum(owner, 0)]
    parts = np.where(word, _BYTE_HASH[data] * _POWERS[place % BLOCK], np.uint64(0))
    if (last - first).max() >= BLOCK:
        # Later blocks are replaced by a hash of their bytes and number, at their first byte.
        starts = np.flatnonzero(word & (place % BLOCK == 0))
        sums, number = np.add.reduceat(parts, starts), (place[starts] // BLOCK).astype(np.uint64)
        parts = np.zeros(len(data), np.uint64)
        parts[starts] = np.where(number > 0, mixed(sums + number * _BLOCK_STEP), sums)
    return mixed(np.add.reduceat(parts, first)), np.searchsorted(first, offsets), first, last + 1


def recurring(codes: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of the windows, each at least once, whose hash windows of two documents have.

    ``codes``: the words of all lines, ``sizes``: words of each line, ``docs``: document of each line.
    """
    # The hash of a window is a difference of running sums, freed of its place by a power.
    step = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.full(len(codes) + 1, step, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + step) * powers[: len(codes)])])
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(len(codes)) + WORDS <= ends)
    hashes = (sums[at + WORDS] - sums[at]) * powers[len(codes) - at]
    owner = np.repeat(docs, sizes)[at]
    order = np.lexsort((owner, hashes))
    at, hashes, owner = at[order], hashes[order], owner[order]
    new = np.diff(hashes, prepend=~hashes[:1]) != 0
    starts = np.flatnonzero(new)
    last = np.concatenate([starts[1:], [len(at)]]).astype(np.int64)[: len(starts)] - 1
    several = np.repeat(owner[starts] != owner[last], last - starts + 1)
    # Different windows of one hash are all passages of their own.
    for k in range(WORDS):
        new[1:] |= codes[at[1:] + k] != codes[at[:-1] + k]
    return at[new & several]


def confirm(texts: list[bytes], docs: np.ndarray, anchors: np.ndarray):
    """Windows that an earlier document's stretch holds, word for word.

    Passages whose hash recurs in another document are compiled into an automaton. All
    stretches stream through it: what it locates is equal word for word, and tells
    each passage's earliest document and all its later places.
    """
    lines = [text.split() for text in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    numbers = {word: k for k, word in enumerate(dict.fromkeys(chain.from_iterable(lines)))}
    codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lines)), np.int64, int(sizes.sum()))
    candidates = recurring(codes, sizes, docs)
    if not len(candidates):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Letters are numbers of words, so that a match begins and ends at words.
    letters = tuple(codes.tolist())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, at in enumerate(candidates.tolist()):
        automaton.add_word(letters[at : at + WORDS], k)
    automaton.make_automaton()
    ends = np.cumsum(sizes)
    located: list[tuple[int, int]] = []
    counts = []
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        before = len(located)
        located.extend(automaton.iter(letters[start:end]))
        counts.append(len(located) - before)
    last, passage = np.array(located, np.int64).T
    which = np.repeat(np.arange(len(lines)), counts)
    earliest = np.full(len(candidates), np.iinfo(np.int64).max)
    np.minimum.at(earliest, passage, docs[which])
    later = earliest[passage] < docs[which]
    return which[later], last[later] + 1 - WORDS


RULE = Rule(WORDS, 5, word_units, confirm, cut=False)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, spans, kept = [], [], [], []
        for body, hits in zip(batch.column("body").to_pylist(), own_hits(batch), strict=True):
            words = body.split()
            runs = covered(hits, WORDS)
            edges = [0, *(x for run in runs for x in run), len(words)]
            n_words.append(len(words))
            n_removed.append(sum(j - i for i, j in runs))
            spans.append([{"start": i, "end": j} for i, j in runs])
            kept.append(b" ".join(w for i, j in zip(edges[::2], edges[1::2], strict=True) for w in words[i:j]).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "spans", "kept"],
        )


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the 13-word passages that start in an earlier document.

    Returns ``doc_id, n_words, n_removed, spans, kept``: the removed runs as word
    ranges and the words that stay, joined by one space. Words are taken
    unchanged from whole texts; passages are judged on the input. Null, empty and
    short texts keep all they have. Equal ids count as one document, whose rows
    remove nothing from each other; a null id takes no part and loses nothing. An
    empty table gives an empty result; other columns are not looked at.
    """
    return earlier_windows(docs, RULE, id_col, text_col).mapInArrow(cut_out, SPANS)
