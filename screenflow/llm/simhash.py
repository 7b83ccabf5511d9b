"""SimHash near-dedup with pivot distance tables.

A fingerprint is cut into 8 segments of 8 bits. Per segment, the Hamming distances
of all 256 values to many reference fingerprints are precomputed: the coordinates of
a value. By the triangle inequality two values differ in at least as many bits as the
largest difference of a coordinate, so the sum of these bounds over the segments
bounds the distance of two fingerprints from below.

Fingerprints within ``bits`` bits agree in all but ``bits`` segments, so there all
their coordinates agree: each fingerprint meets the others that have its coordinates
in some choice of the remaining segments (28 choices for 2 bits). What meets in such
a bucket is distinct and differs in the left-out segments alone, so a bucket holds at
most 256 ** bits fingerprints, however many documents or near copies there are. In a
bucket, pairs whose bounds exceed ``bits`` are discarded, and the survivors verified.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.llm.common import binary_column, col, mixed, stored
from screenflow.llm.minmax import components

SEGMENTS, REFERENCES = 8, 16
#: The seed of the shingles' hash.
SEED = 42
#: Bytes of text, and shingles, handled at once.
PIECE, HASHED = 1 << 20, 1 << 15
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, A-Z in lower case, in pieces of about ``PIECE`` bytes."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        yield text[at:stop].lower().split()
        at = stop


def fingerprint(text: bytes, size: int) -> int:
    """The 64-bit SimHash over all shingles of ``size`` words, repeats included; 0 without words."""
    ones, n, last = np.zeros(64, np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        nonlocal n
        for at in range(0, len(shingles), HASHED):
            digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles[at : at + HASHED]])
            ones[:] += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(shingles)

    for words in words_of(text):
        words = last + words
        count([b" ".join(s) for s in zip(*(words[k:] for k in range(size)), strict=False)])
        last = words[len(words) - size + 1 :] if len(words) >= size else words
    if n == 0 and last:
        count([b" ".join(last)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column("body"))
            prints = [fingerprint(data[i:j].tobytes(), size) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"])

    return run


class PivotTable:
    """Coordinates of every segment value, and the bounds and bucket keys that follow from them."""

    def __init__(self, bits: int):
        references = mixed(np.arange(1, REFERENCES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        values = np.arange(256, dtype=np.uint8)
        self.bits = bits
        self.choices = list(itertools.combinations(range(SEGMENTS), bits))
        self.left_out = np.array(self.choices, np.int64).reshape(len(self.choices), bits)
        # By the segments that differ, as 8 bits: the first choice that leaves them all out.
        masks = np.array([np.packbits(np.isin(np.arange(SEGMENTS), c))[0] for c in self.choices], np.uint8)
        fits = (np.arange(256)[:, None] & ~masks[None, :].astype(np.int64)) == 0
        self.first_choice = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
        # coordinates[segment, value, reference]
        cut = references.view(np.uint8).reshape(REFERENCES, SEGMENTS)
        self.coordinates = np.bitwise_count(values[None, :, None] ^ cut.T[:, None, :]).astype(np.int16)
        apart = np.abs(self.coordinates[:, :, None, :] - self.coordinates[:, None, :, :])
        self.bound = apart.max(axis=3).astype(np.uint8)
        marks = np.zeros((SEGMENTS, 256), np.uint64)
        for r in range(REFERENCES):
            marks = mixed(marks + self.coordinates[:, :, r].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.marks = mixed(marks + np.arange(1, SEGMENTS + 1, dtype=np.uint64)[:, None])

    def segments(self, prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints, np.uint64).view(np.uint8).reshape(-1, SEGMENTS)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """A key for every print and choice of left-out segments; its low 6 bits are the choice."""
        marks = self.marks[np.arange(SEGMENTS), self.segments(prints)]
        whole = marks.sum(axis=1, dtype=np.uint64)
        out = np.empty((len(prints), len(self.choices)), np.uint64)
        for i, choice in enumerate(self.choices):
            rest = whole - marks[:, list(choice)].sum(axis=1, dtype=np.uint64)
            out[:, i] = (mixed(rest) & ~np.uint64(63)) | np.uint64(i)
        return out

    def links(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of prints with one key that differ in ``bits`` bits at most; rows must be sorted by key."""
        found_a, found_b = [], []
        cut, choice = self.segments(prints), self.left_out[(keys & np.uint64(63)).astype(np.int64)]
        a = np.arange(len(keys) - 1)
        step = 1
        while True:
            a = a[a + step < len(keys)]
            a = a[keys[a] == keys[a + step]]
            if not len(a):
                break
            b = a + step
            least = np.zeros(len(a), np.int64)
            for k in range(self.bits):
                s = choice[a, k]
                least += self.bound[s, cut[a, s], cut[b, s]]
            near = least <= self.bits
            x, y = prints[a[near]], prints[b[near]]
            differs = x ^ y
            # A pair that agrees in a left-out segment meets under several keys; the first choice that fits reports it.
            first = self.first_choice[np.packbits(self.segments(differs) != 0, axis=1)[:, 0]]
            true = (np.bitwise_count(differs) <= self.bits) & (differs != 0) & (first == (keys[a[near]] & np.uint64(63)).astype(np.int64))
            found_a.append(x[true])
            found_b.append(y[true])
            step += 1
        empty = np.zeros(0, np.uint64)
        return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def bucket_entries(bits: int):
    """One row for each print and choice of left-out segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PivotTable(bits)
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            keys = table.keys(prints)
            each = np.repeat(prints, keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(each.view(np.int64))], ["key", "print"])

    return run


def bucket_links(bits: int):
    """Links within the buckets of rows sorted by key. At most one bucket waits for its next rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PivotTable(bits)
        keys = prints = np.zeros(0, np.uint64)

        def found(k, p):
            a, b = table.links(k, p)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
            prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            done = int(np.flatnonzero(keys == keys[-1])[0]) if len(keys) else 0
            yield found(keys[:done], prints[:done])
            keys, prints = keys[done:], prints[done:]
        yield found(keys, prints)

    return run


def print_links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of the distinct ``print`` values that differ in 1 to ``bits`` bits, each pair once."""
    if not 1 <= bits <= 3:
        raise ValueError("bits must be 1, 2 or 3")
    entries = prints.select("print").mapInArrow(bucket_entries(bits), "key bigint, print bigint")
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links(bits), "a bigint, b bigint")


def simhash_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, bits: int = 2
) -> DataFrame:
    """``doc_id, print, component_id, kept`` for every row of ``docs``; ``print`` holds the 64 bits.

    Documents link if their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest document id that links reach, ``kept`` marks that
    document. Texts are read whole. Null, empty and blank texts have the fingerprint 0,
    which links like any other; a text with fewer words than a shingle is one shingle.
    Rows that repeat an id are one document, linked by any of their texts. Rows without
    id have a fingerprint but belong to no component (null) and are kept. An empty table
    gives an empty result; other columns are not looked at.
    """
    bodies = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("body"))
    prints = stored(bodies.mapInArrow(fingerprints(shingle_words), "doc_id bigint, print bigint"), "prints")
    known = prints.filter("doc_id is not null")
    # One representative for each fingerprint; a document with several rows links its fingerprints.
    classes = stored(known.groupBy("print").agg(F.min("doc_id").alias("label")), "print-classes")
    several = known.groupBy("doc_id").agg(F.min("print").alias("b"), F.max("print").alias("top")).filter("b < top")
    own = known.join(several.select("doc_id", "b"), "doc_id").filter("print != b").select(F.col("print").alias("a"), "b")
    links = stored(print_links(classes, bits).union(own), "print-links")
    # Only linked fingerprints take part in the rounds.
    linked = links.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    labels = stored(classes.join(linked, "print").select(F.col("print").alias("id"), "label"), "print-labels")
    labels = components(labels, links).select(F.col("id").alias("print"), F.col("label").alias("lowest"))
    component = F.coalesce("lowest", "label").alias("component_id")
    resolved = classes.join(labels, "print", "left").select("print", component)
    found = known.join(resolved, "print").select("doc_id", "print", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))
    nameless = prints.filter("doc_id is null").select("doc_id", "print", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(nameless)
