"""Importance resampling towards a target distribution, with overlapped regex scanning.

Separators of a text collapse to single spaces, and one regular expression for each
length finds the n-grams: boundary lookarounds hold both ends to words, and overlapped
search emits the span of every run, whose bytes are hashed by CRC into a bucket. The
bucket counts of the corpus and of the target give each bucket a gain; documents are
drawn by the sum of their gains and a hash-seeded Gumbel draw.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenflow.llm.common import binary_column, col, free_name, stored

#: Bytes between words, after A-Z are lower-cased.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of text scanned at once.
PIECE = 1 << 20


def gram_pattern(n: int):
    """Finds runs of ``n`` words between single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def word_runs(text: bytes, n: int) -> Iterator[tuple[bytes, int]]:
    """``text`` collapsed, in pieces; and how many words at a piece's start were in the piece before.

    A piece starts with the last ``n`` - 1 words of the one before, so no run is cut.
    """
    at, last, text = 0, [], text.lower()
    while at < len(text):
        gap = SEPARATORS.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = gap.end() if gap else len(text)
        own = SEPARATORS.sub(b" ", text[at:stop]).strip(b" ")
        if own:
            yield b" ".join([*last, own]), len(last)
            last = [*last, *own.rsplit(b" ", n)[-n:]][-(n - 1) :] if n > 1 else []
        at = stop


def buckets_of(text: bytes, patterns: list, buckets: int) -> tuple[int, list[int]]:
    """Words, and the bucket of every run of 1 to ``len(patterns)`` words, of a whole text."""
    n_words, found = 0, []
    for piece, repeated in word_runs(text, len(patterns)):
        n_words += piece.count(b" ") + 1 - repeated
        for size, pattern in enumerate(patterns, 1):
            spans = pattern.finditer(piece, overlapped=True)
            # Runs that lie within the repeated words were found before.
            for _ in range(max(0, repeated - size + 1)):
                next(spans)
            found += [zlib.crc32(m.group()) % buckets for m in spans]
    return n_words, found


def counted(max_words: int, buckets: int):
    """Per row: words, features, and its buckets with their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [gram_pattern(n) for n in range(1, max_words + 1)]
        for batch in batches:
            data, offsets = binary_column(batch.column("body"))
            words, features, packed = [], [], []
            for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                n_words, found = buckets_of(data[i:j].tobytes(), patterns, buckets)
                each, times = np.unique(np.array(found, np.uint32), return_counts=True)
                words.append(n_words)
                features.append(len(found))
                packed.append(np.concatenate([each, times.astype(np.uint32)]).tobytes())
            columns = [pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "packed"])

    return run


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of everything packed in a batch."""
    data, offsets = binary_column(batch.column("packed"))
    numbers = np.frombuffer(data.tobytes(), np.uint32).astype(np.int64)
    ends = offsets // 4
    half = np.diff(ends) // 2
    row = np.repeat(np.arange(len(half)), half)
    at = np.arange(len(row)) + np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(half)])[:-1], half)
    return row, numbers[at], numbers[at + np.repeat(half, half)]


def task_totals(buckets: int):
    """The bucket counts of all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, bucket, count = entries(batch)
            np.add.at(total, bucket, count)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    return run


def weights(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, count = entries(batch)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, row, gains[bucket] * count)
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def bucket_counts(texts: DataFrame, id_col: str | None, text_col: str, max_words: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, n_features, packed`` of every row, whole texts."""
    doc = F.lit(None).cast("bigint") if id_col is None else col(id_col).cast("bigint")
    bodies = texts.select(doc.alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("body"))
    return bodies.mapInArrow(counted(max_words, buckets), "doc_id bigint, n_words bigint, n_features bigint, packed binary")


def totals(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all rows by bucket: ``buckets`` numbers, the parameter, reach the driver."""
    sums = counts.mapInArrow(task_totals(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to corpus share, for each bucket."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [float((b + 1) * (s + n)) / float((a + 1) * (t + n)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gumbel(doc: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def importance_scores(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    max_words: int = 2, buckets: int = 10_000, seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for every row of ``docs``; see ``resample``."""
    counts = stored(bucket_counts(docs, id_col, text_col, max_words, buckets), "bucket-counts")
    gains = bucket_gains(totals(counts, buckets), totals(bucket_counts(target, None, target_col, max_words, buckets), buckets))
    weighed = counts.mapInArrow(weights(gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    max_words: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null if it is not drawn.

    Of the rows with ``least_words`` words, ``percent`` percent with the highest score
    are drawn, ranked from 1, ties to the smaller id (null ids last), then to fewer
    features. Texts are read whole. Null, empty and blank texts have no features, the
    weight 0, and are never drawn. Rows that repeat an id are ranked one by one. Without
    a target text every bucket's target count is 0. An empty table gives an empty
    result; other columns are not looked at.
    """
    scored = importance_scores(docs, target, id_col, text_col, target_col, max_words, buckets, seed)
    scored = stored(scored, "scores")
    able = F.col("n_words") >= least_words
    # A sort deals out ranges in order; a row's rank is its place in its range after the rows of the ranges before.
    ordered = scored.filter(able).sort(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features")
    place = F.monotonically_increasing_id()
    ordered = stored(ordered.select("*", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranked")
    sizes = ordered.groupBy("range").agg(F.count("*").alias("n"))  # a row for each partition of the sort
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n_drawn = F.floor(F.lit(percent) * sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / 100).cast("bigint")
    rank = F.col("start") + F.col("place") + 1
    ranked = ordered.join(starts, "range").select("doc_id", "n_features", "weight", "score", F.when(rank <= n_drawn, rank).alias("rank"))
    rest = scored.filter(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.union(rest)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns. Rows that repeat an id go together; null ids are not drawn."""
    ranked = resample(docs, target, id_col, text_col, target_col, **options).filter("rank is not null and doc_id is not null")
    name = free_name(docs, "drawn_id")
    return docs.join(ranked.select(F.col("doc_id").alias(name)).distinct(), col(id_col).cast("bigint") == F.col(name), "left_semi")
