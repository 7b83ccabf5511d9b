"""Find and remove passages that also start in an earlier document.

Both substring operators ask the same question: which windows of a fixed number
of units (bytes or words) of a document also start in a document with a smaller
id. The corpus is never compared window by window:

1. Every window owns one anchor, the smallest gram hash inside it (the leftmost
   of equal ones). Equal windows own equal anchors, and neighbouring windows
   mostly share theirs. Only anchor hashes travel, packed by hash range, to find
   those that two documents have. What is common inside one Arrow batch is found
   there and sent once, so that a frequent passage costs a row a batch.
2. The stretches of windows that own a shared anchor travel, with their text,
   to the anchor's shard, where the operator's own method confirms them on the
   text itself. Of equal stretches in a batch only the earliest document's goes.
3. Confirmed windows come back by document id and a digest of the row's text, as rows
   with one id may have different texts. The exchange of whole texts is planned once
   and reused for both steps that need them.

What a batch has answered itself (``TOLD``) goes by document, not by anchor, so a very
frequent passage does not fill its anchor's shard.

Documents without id take no part: nothing is removed from or because of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.llm.common import binary_column, col, joined_rows, mixed, packed_by, shards

#: Units handled at once, for arrays that stay in the processor's cache.
PIECE = 1 << 17
_POSITION = np.uint64((1 << 18) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose units are laid out at once.
TOGETHER_BYTES = 1 << 20
#: Stretches confirmed at once; those of one anchor stay together.
TOGETHER = 1 << 13
#: Pairs packed and sent at once, as each copy of them takes memory.
SENT = 1 << 18
ASKED, KNOWN, TOLD = 0, 1, 2
PAIRS = "shard int, state byte, low binary, high binary, docs binary"
STRETCHES = "shard int, state byte, docs binary, rows binary, firsts binary, sizes binary, text binary, anchors binary"
HITS = "doc_id bigint, hits binary"


class Rule(NamedTuple):
    """What an operator looks for: ``window`` units, anchored by grams of ``gram`` units.

    ``units`` turns the bytes of some rows and their offsets into a hash for each
    unit, the units' row offsets, and each unit's first and end byte. ``cut``:
    bytes are units, so that long rows can be read in parts.
    ``confirm`` gets the texts of stretches, their documents and anchors, and
    returns (stretch, window) of every window that an earlier
    document has.
    """

    window: int
    gram: int
    units: Callable
    confirm: Callable
    cut: bool


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def anchors(units: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor: first window, last window, anchor hash.

    ``ends[i]`` is where the document of unit i ends; windows over it don't exist.
    """
    n = len(units) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    # Hashes of 1, 2, 4 ... units, each of two of the size before; the gram is a sum of some.
    sizes = {1: units}
    while 2 * (size := max(sizes)) <= gram:
        sizes[2 * size] = sizes[size][: len(sizes[size]) - size] + sizes[size][size:] * _power(size)
    total, done = np.zeros(len(units) - gram + 1, np.uint64), 0
    for size in sorted(sizes, reverse=True):
        if done + size <= gram:
            total += sizes[size][done : done + len(total)] * _power(done)
            done += size
    hashes = mixed(total)
    low = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        low, have = np.minimum(low[: len(low) - have], low[have:]), have * 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    at = (low & _POSITION).astype(np.int64)
    ok = np.arange(n) + window <= ends[:n]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last), hashes[at[first]]


def parts(offsets: np.ndarray, window: int, cut: bool) -> Iterator[tuple[int, int, int, int]]:
    """Rows i to j and their bytes, about ``TOGETHER_BYTES`` at once; a longer row comes alone, cut with overlap if it may be."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER_BYTES, side="right")) - 1)
        start, stop = int(offsets[i]), int(offsets[j])
        if cut and stop - start > TOGETHER_BYTES:
            for at in range(start, stop - window + 1, TOGETHER_BYTES - window + 1):
                yield i, j, at, min(stop, at + TOGETHER_BYTES)
        else:
            yield i, j, start, stop
        i = j


#: What `batch_anchors` gives for each run of windows with one anchor.
ROW, FIRST, WINDOWS, BEGIN, END, HASH = range(6)


def batch_anchors(
    rule: Rule, data: np.ndarray, offsets: np.ndarray, columns: Sequence[int] = range(6), keep: Callable | None = None
) -> list[np.ndarray]:
    """Runs of windows with one anchor in a batch: row, first window in the row, windows, first byte, end byte, hash.

    Only the ``columns`` asked for are gathered, of those runs that ``keep`` finds among the
    rows and hashes of a piece: a batch has far more runs than are needed at once.
    """
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64 if k == HASH else np.int64)] for k in columns]
    for i, j, start, stop in parts(offsets, rule.window, rule.cut):
        units, at, begin, end = rule.units(data[start:stop], np.clip(offsets[i : j + 1], start, stop) - start)
        ends = np.repeat(at[1:], np.diff(at))
        for k in range(0, max(len(units) - rule.window + 1, 0), PIECE - rule.window + 1):
            stop_unit = min(len(units), k + PIECE)
            first, last, hashes = anchors(units[k:stop_unit], np.minimum(ends[k:stop_unit], stop_unit) - k, rule.window, rule.gram)
            first, last = first + k, last + k
            row = np.searchsorted(at, first, side="right") - 1
            if keep is not None:
                kept = np.flatnonzero(keep(row + i, hashes))
                first, last, hashes, row = first[kept], last[kept], hashes[kept], row[kept]
            before = start - int(offsets[i])
            values = (row + i, first - at[row] + before, last - first + 1, begin[first] + start, end[last + rule.window - 1] + start, hashes)
            for out, column in zip(found, columns, strict=True):
                out.append(values[column])
    whole = []
    for out in found:
        whole.append(np.concatenate(out))
        out.clear()
    return whole


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The shard comes from the upper bits; the lower 40 tell anchors of a shard apart.

    Anchors only propose, so two that fall together cost a comparison, no more.
    """
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def named(hashes: np.ndarray, n: int) -> np.ndarray:
    """An anchor's shard and its lower 40 bits, in one number."""
    return hashes & np.uint64((1 << 40) - 1) | shard_of(hashes, n).astype(np.uint64) << np.uint64(40)


def told_shard(docs: np.ndarray, n: int) -> np.ndarray:
    """Shards beyond those of the anchors, for what needs no anchor's shard any more."""
    return (n + (mixed(docs.view(np.uint64)) % np.uint64(n)).astype(np.int64)).astype(np.int32)


def in_parts(shard: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """``order``, which sorts by shard, in parts of about ``SENT`` entries that cut no shard."""
    i = 0
    while i < len(order):
        j = len(order)
        if j - i > SENT:
            j = i + int(np.searchsorted(shard[order[i:]], shard[order[i + SENT]], side="right"))
        yield order[i:j]
        i = j


def find_pairs(rule: Rule, n_shards: int):
    """Packed (anchor, document) pairs of every batch, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column("body"))
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            row, hashes = batch_anchors(rule, data, offsets, (ROW, HASH))
            docs = ids[row]
            order = np.lexsort((docs, hashes))
            hashes, docs = hashes[order], docs[order]
            del row, order
            new_hash = np.diff(hashes, prepend=~hashes[:1]) != 0
            new = new_hash | (np.diff(docs, prepend=docs[:1]) != 0)
            hashes, docs, new_hash = hashes[new], docs[new], new_hash[new]
            starts = np.flatnonzero(new_hash)
            several = np.diff([*starts, len(hashes)]) > 1
            known = np.repeat(several, np.diff([*starts, len(hashes)]))
            new_hash &= known
            for state, keep in ((ASKED, ~known), (KNOWN, new_hash), (TOLD, known)):
                h, d = hashes[keep], docs[keep]
                shard = told_shard(d, n_shards) if state == TOLD else shard_of(h, n_shards)
                order = np.argsort(shard, kind="stable") if state == TOLD else np.lexsort((d, shard))
                for part in in_parts(shard, order):
                    if state == TOLD:
                        # Each document beside the whole name of its anchor.
                        keys, (names, told) = packed_by(shard[part], [named(h[part], n_shards), d[part]])
                        packed = [names, [b""] * len(keys), told]
                    else:
                        mine = h[part]
                        keys, packed = packed_by(shard[part], [mine.astype(np.uint32), (mine >> np.uint64(32)).astype(np.uint8), d[part]])
                        if state == KNOWN:
                            packed[2] = [b""] * len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int32()), pa.array([state] * len(keys), pa.int8()), *(pa.array(x, pa.binary()) for x in packed)],
                        ["shard", "state", "low", "high", "docs"],
                    )

    return run


def unpacked(table: pa.Table) -> np.ndarray:
    """The 40 bits of all packed anchors."""
    return joined_rows(table.column("low"), np.uint32).astype(np.uint64) | joined_rows(table.column("high"), np.uint8).astype(np.uint64) << np.uint64(32)


def share(table: pa.Table) -> pa.Table:
    """The pairs of one shard whose anchor another document has too.

    The result names an anchor by its shard and 40 bits, in one number.
    """
    state = table.column("state").to_numpy()
    asked, known, told = (table.filter(pa.array(state == s)) for s in (ASKED, KNOWN, TOLD))
    hashes, docs = unpacked(asked), joined_rows(asked.column("docs"), np.int64)
    order = np.argsort(hashes)
    hashes, docs = hashes[order], docs[order]
    twin = np.zeros(len(hashes), bool)
    twin[1:] = hashes[1:] == hashes[:-1]
    twin[:-1] |= twin[1:].copy()
    elsewhere = np.sort(unpacked(known))
    if len(elsewhere):
        at = np.minimum(np.searchsorted(elsewhere, hashes), len(elsewhere) - 1)
        twin |= elsewhere[at] == hashes
    shard = np.uint64(table.column("shard")[0].as_py())
    names = (hashes[twin] | shard << np.uint64(40)).view(np.int64)
    return pa.table({
        "doc_id": pa.array(np.concatenate([docs[twin], joined_rows(told.column("docs"), np.int64)])),
        "anchor": pa.array(np.concatenate([names, joined_rows(told.column("low"), np.int64)])),
    })


def squeezed(rows: list[bytes]) -> list[bytes]:
    """The packed rows compressed, as these texts are most of what is shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(x) for x in rows]


def spread(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All numbers packed and compressed into the rows of a binary column."""
    open_ = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join([open_.decompress(x) for x in column.to_pylist()]), dtype)


def find_stretches(rule: Rule, n_shards: int):
    """Stretches of windows that own a shared anchor, packed by shard.

    A stretch that the same batch holds in an earlier document is answered here
    (``TOLD``: its windows are hits) and doesn't travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column("body"))
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            digests = batch.column("row").to_numpy(zero_copy_only=False)
            lists = batch.column("anchors")
            wanted = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            owner = np.repeat(np.arange(len(ids), dtype=np.uint64), lengths)
            shared = np.sort(wanted ^ mixed(owner + _STEP))
            del wanted, owner

            def is_shared(row: np.ndarray, hashes: np.ndarray, shared=shared) -> np.ndarray:
                if not len(shared):
                    return np.zeros(len(row), bool)
                mine = named(hashes, n_shards) ^ mixed(row.astype(np.uint64) + _STEP)
                return shared[np.minimum(np.searchsorted(shared, mine), len(shared) - 1)] == mine

            row, first, n, begin, end, hashes = batch_anchors(rule, data, offsets, keep=is_shared)
            order = np.argsort(ids[row], kind="stable")
            row, first, n, begin, end, hashes = (x[order] for x in (row, first, n, begin, end, hashes))
            shard = shard_of(hashes, n_shards)
            docs, rows = ids[row], digests[row]
            raw = data.tobytes()
            earliest: dict[bytes, int] = {}
            texts = [raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            told = np.fromiter((earliest.setdefault(t, d) < d for t, d in zip(texts, docs.tolist(), strict=True)), bool, len(texts))
            for state, keep in ((ASKED, ~told), (TOLD, told)):
                at = np.flatnonzero(keep)
                goes = told_shard(docs, n_shards) if state == TOLD else shard
                at = at[np.argsort(goes[at], kind="stable")]
                sizes = (n if state == TOLD else end - begin)[at].astype(np.int32)
                keys, (d, r, f, s, h) = packed_by(goes[at], [docs[at], rows[at], first[at].astype(np.uint32), sizes, hashes[at].astype(np.uint32)])
                cuts = np.flatnonzero(np.diff(goes[at], prepend=-1))
                blobs = [b"".join([texts[k] for k in part]) if state == ASKED else b"" for part in np.split(at, cuts[1:])] if len(at) else []
                if state == TOLD:
                    h = [b""] * len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int32()), pa.array([state] * len(keys), pa.int8()), *(pa.array(squeezed(x), pa.binary()) for x in (d, r, f, s, blobs, h))],
                    ["shard", "state", "docs", "rows", "firsts", "sizes", "text", "anchors"],
                )

    return run


def confirm_shard(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        state = table.column("state").to_numpy()
        asked, told = (table.filter(pa.array(state == s)) for s in (ASKED, TOLD))
        docs, rows = spread(asked.column("docs"), np.int64), spread(asked.column("rows"), np.int64)
        firsts = spread(asked.column("firsts"), np.uint32).astype(np.int64)
        sizes = spread(asked.column("sizes"), np.int32).astype(np.int64)
        anchor = spread(asked.column("anchors"), np.uint32)
        text = spread(asked.column("text"), np.uint8).tobytes()
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(anchor, kind="stable")
        cuts = np.flatnonzero(np.diff(anchor[order], prepend=anchor[order][:1]) != 0)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = 0
        while at < len(order):
            k = np.searchsorted(cuts, at + TOGETHER)
            stop = len(order) if k == len(cuts) else int(cuts[k])
            part = order[at:stop]
            texts = [text[i : i + n] for i, n in zip(begins[part].tolist(), sizes[part].tolist(), strict=True)]
            which, window = rule.confirm(texts, docs[part], anchor[part])
            found.append((part[which], window))
            at = stop
        which, window = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((window, which))
        which, window = which[order], window[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)
        starts = np.flatnonzero(new)
        runs = np.diff([*starts, len(which)]).astype(np.int64)
        doc = np.concatenate([docs[which[starts]], spread(told.column("docs"), np.int64)])
        row = np.concatenate([rows[which[starts]], spread(told.column("rows"), np.int64)])
        first = np.concatenate([firsts[which[starts]] + window[starts], spread(told.column("firsts"), np.uint32).astype(np.int64)])
        n = np.concatenate([runs, spread(told.column("sizes"), np.int32).astype(np.int64)])
        # One value for each row of a document that this shard has hits for: the row's digest, then the hits.
        order = np.lexsort((row, doc))
        doc, row, hits = doc[order], row[order], (first << 24 | n)[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        packed = [row[i].tobytes() + hits[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(hits)][: len(starts)], strict=True)]
        return pa.table({"doc_id": doc[starts], "hits": pa.array(packed, pa.binary())})

    return run


def own_hits(batch: pa.RecordBatch) -> Iterator[list[int]]:
    """The hits of each row of a batch, out of those of all rows with its id."""
    for row, found in zip(batch.column("row").to_pylist(), batch.column("hits"), strict=True):
        packed = [np.frombuffer(x, np.int64) for x in found.as_py() or ()]
        yield [h for x in packed if x[0] == row for h in x[1:].tolist()]


def covered(hits: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of units that hit windows cover, as (start, end). A hit is its first window and 24 bits of their number."""
    runs: list[tuple[int, int]] = []
    for first, n in sorted((h >> 24, h & 0xFFFFFF) for h in hits):
        end = first + n - 1 + window
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], end))
        else:
            runs.append((first, end))
    return runs


def earlier_windows(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``body`` (the text's bytes), ``row`` and ``hits``: runs of windows that an earlier document has, see `own_hits`.

    One row for each row of ``docs``. Rows that repeat a document id belong to one
    document, so they remove nothing from each other; each keeps its own hits.
    """
    bodies = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("body"))
    row = F.xxhash64("body")
    n = shards(docs, text_col)
    asked = bodies.filter("doc_id is not null").mapInArrow(find_pairs(rule, n), PAIRS)
    shared = asked.groupBy("shard").applyInArrow(share, "doc_id bigint, anchor bigint")
    lists = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    # Left joins both, so that the exchange of the texts is the same one and is reused.
    candidates = bodies.join(lists.hint("merge"), "doc_id", "left")
    body = F.when(F.col("anchors").isNotNull(), F.col("body"))
    stretches = candidates.select("doc_id", body.alias("body"), row.alias("row"), "anchors").mapInArrow(find_stretches(rule, n), STRETCHES)
    hits = stretches.groupBy("shard").applyInArrow(confirm_shard(rule), HITS)
    by_doc = hits.groupBy("doc_id").agg(F.collect_list("hits").alias("hits"))
    return bodies.join(by_doc.hint("merge"), "doc_id", "left").select("doc_id", "body", row.alias("row"), "hits")
