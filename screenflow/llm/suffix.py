"""Suffix-array dedup: remove byte strings that an earlier document has.

Longest-previous-factor arrays over sharded suffix arrays. Suffixes (one for
each window of candidate text) are bucketed by anchor, which equal windows share,
and sorted bytewise inside the bucket. The previous and the next entry with a
smaller document id in that order give the longest factor that an earlier
document has; a factor of the whole window marks a copy to remove, and the first
copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from screenflow.llm.anchors import Rule, covered, earlier_windows, own_hits
from screenflow.llm.common import mixed

#: Bytes of a string that counts as repeated.
LENGTH = 50
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SPANS = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def byte_units(data: np.ndarray, offsets: np.ndarray):
    """Each byte is a unit."""
    at = np.arange(len(data))
    return _BYTE_HASH[data], offsets, at, at + 1


def words_at(text: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The ``length`` bytes from each position as big-endian numbers, whose order is bytewise."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = []
    for k in range(0, length, 8):
        word = np.ascontiguousarray(eight[at + k]).view(">u8")[:, 0].astype(np.uint64)
        out.append(word >> np.uint64(8 * max(0, k + 8 - length)))
    return out


def suffix_order(bucket: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by (bucket, bytes), and the longest common prefix with the entry before, in words.

    A prefix of all words means equal strings. Only buckets that hold different
    strings are sorted by their bytes.
    """
    order = np.argsort(bucket, kind="stable")
    group = np.cumsum(np.diff(bucket[order], prepend=bucket[order][:1]) != 0)
    for word in words:
        value = word[order]
        differs = np.zeros(len(order), bool)
        differs[1:] = (value[1:] != value[:-1]) & (group[1:] == group[:-1])
        if differs.any():
            mixed_groups = np.zeros(group[-1] + 1, bool)
            mixed_groups[group[differs]] = True
            rows = np.flatnonzero(mixed_groups[group])
            inner = np.lexsort((value[rows], group[rows]))
            order[rows] = order[rows][inner]
            value = word[order]
        group = np.cumsum((np.diff(group, prepend=group[:1]) != 0) | (np.diff(value, prepend=value[:1]) != 0))
    common = np.zeros(len(order), np.int8)
    common[1:][group[1:] == group[:-1]] = len(words)
    return order, common


def previous_smaller(values: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller value, -1 without one.

    ``joined[i]``: entry i shares the whole factor with entry i - 1. The search
    stops where that ends, as a longer factor can't lie beyond. Pointers jump
    over everything their target has already found not to be smaller.
    """
    jump = np.arange(-1, len(values) - 1)
    jump[~joined] = -1
    open_ = np.flatnonzero((jump >= 0) & (values[jump] >= values))
    while len(open_):
        jump[open_] = jump[jump[open_]]
        open_ = open_[(jump[open_] >= 0) & (values[jump[open_]] >= values[open_])]
    return jump


def confirm(texts: list[bytes], docs: np.ndarray, anchors: np.ndarray):
    """Windows of the stretches whose longest previous factor has the full length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
    n = np.maximum(sizes - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(which):
        return which, window
    at = bounds[which] + window
    words = words_at(text, at, LENGTH)
    order, common = suffix_order(anchors[which], words)
    doc, whole = docs[which][order], common == len(words)
    before = previous_smaller(doc, whole)
    back = np.zeros(len(whole), bool)
    back[1:] = whole[:0:-1]
    after = previous_smaller(doc[::-1], back)[::-1]
    hit = order[(before >= 0) | (after >= 0)]
    return which[hit], window[hit]


RULE = Rule(LENGTH, 24, byte_units, confirm, cut=True)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, spans, kept = [], [], [], []
        for body, hits in zip(batch.column("body").to_pylist(), own_hits(batch), strict=True):
            runs = covered(hits, LENGTH)
            edges = [0, *(x for run in runs for x in run), len(body)]
            n_bytes.append(len(body))
            n_removed.append(sum(j - i for i, j in runs))
            spans.append([{"start": i, "end": j} for i, j in runs])
            kept.append(b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the 50-byte strings that start in an earlier document.

    Returns ``doc_id, n_bytes, n_removed, spans, kept``: the removed runs as byte
    ranges and the bytes that stay (they need not be valid UTF-8). Texts are
    taken whole, as UTF-8; matches never cross documents and are judged on the
    input. Null and short texts keep all they have. Equal ids count as one
    document, whose rows remove nothing from each other; a null id takes no part
    and loses nothing. An empty table gives an empty result; other columns are
    not looked at.
    """
    return earlier_windows(docs, RULE, id_col, text_col).mapInArrow(cut_out, SPANS)
