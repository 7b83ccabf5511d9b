"""MinHash near-dedup with min-max hashing.

Every permutation gives two signature values, the minimum and the maximum of its
hashes over the document's shingles, so 100 hash evaluations make 200 values: 40
bands of 5. A pair at the threshold of 0.8 misses all bands with probability
(1 - 0.8^5)^40 = 1e-7. Bands only propose; every link is confirmed on the full
shingle sets.

Equal sets form a class first, whose smallest document id stands for it. Links
are found without listing the pairs of a bucket: each member is checked against
the bucket's smallest member, in a first round against one such hub only, then
against the hub and three random pivots of each of its buckets, as long as it is
not connected with them already. That leaves few buckets with several components.
Of those, buckets of up to 32 members compare all members of different
components. The members of larger ones meet by prefix filtering, which is exact:
with the shingles of each set ordered from the rarest on, two sets of the asked
similarity share a shingle among the first n - ceil(0.8 n) + 1 of each, and the
places of the first shared one leave room for the overlap that is asked. So no
link that the bands propose is lost, whatever the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from screenflow.llm.anchors import parts
from screenflow.llm.common import binary_column, col, free_name, mixed, stored
from screenflow.llm.phrases import word_units

PERMUTATIONS, BAND_ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Random members of a bucket that all its members are compared with, besides the smallest.
PIVOTS = 3
#: Buckets up to this size compare all members that are still in different components; larger ones use prefixes.
SMALL_BUCKET = 32
#: Similarity of linked documents, in percent.
PERCENT = 80
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_SHIFTS = mixed(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Shingles hashed at once.
PIECE = 1 << 15
SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and the row offsets.

    Words are lower-cased in A-Z only. A row with fewer words than ``size`` has
    its whole word sequence as one shingle, a row without words has none.
    """
    data, offsets = binary_column(batch.column("body"))
    shingles, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j, start, stop in parts(offsets, size, cut=False):
        words, at, _, _ = word_units(_LOWER[data[start:stop]], offsets[i : j + 1] - start)
        n_words = np.diff(at)
        row = np.repeat(np.arange(j - i), n_words)
        ends = np.repeat(at[1:], n_words)
        here = np.arange(len(words))
        total = np.zeros(len(words), np.uint64)
        for k in range(size):
            inside = here + k < ends
            value = np.where(inside, words[np.minimum(here + k, max(len(words) - 1, 0))], np.uint64(0))
            total = mixed(total + value + np.where(inside, np.uint64(k + 1), np.uint64(0)) * _GOLD)
        keep = (here + size <= ends) | (here == ends - np.repeat(n_words, n_words))
        row, total = row[keep], total[keep]
        order = np.lexsort((total, row))
        row, total = row[order], total[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
        shingles.append(total[new])
        counts.append(np.bincount(row[new], minlength=j - i))
    return np.concatenate(shingles), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum, then maximum of every permutation; rows must not be empty."""
    n = len(offsets) - 1
    out = np.empty((2 * PERMUTATIONS, n), np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        part, starts = shingles[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        for p in range(PERMUTATIONS):
            values = part * _FACTORS[p] + _SHIFTS[p]
            values ^= values >> np.uint64(32)
            out[p, i:j] = np.minimum.reduceat(values, starts)
            out[PERMUTATIONS + p, i:j] = np.maximum.reduceat(values, starts)
        i = j
    return out


def sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, offsets = shingle_sets(batch, size)
            counts = np.diff(offsets)
            filled = np.flatnonzero(counts)
            inner = np.append(offsets[filled], offsets[-1])
            set_a, set_b = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            lists = [None] * len(counts)
            if len(filled):
                set_a[filled] = np.add.reduceat(mixed(shingles + _GOLD), offsets[filled])
                set_b[filled] = np.add.reduceat(mixed(shingles ^ _GOLD), offsets[filled])
                values = signatures(shingles, inner)
                bands = np.zeros((BANDS, len(filled)), np.uint64)
                for k in range(BAND_ROWS):
                    bands = mixed(bands + values[k::BAND_ROWS] + _GOLD)
                for at, line in zip(filled.tolist(), bands.T.copy().view(np.int64), strict=True):
                    lists[at] = line
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, offsets = shingle_sets(batch, size)
            packed = [shingles[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "shingles"])

    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of packed sets, with the set's size."""
    for batch in batches:
        data, offsets = binary_column(batch.column("shingles"))
        sizes = np.diff(offsets) // 8
        rows = np.repeat(np.arange(len(sizes)), sizes)
        shingles = data[offsets[0] : offsets[-1]].copy().view(np.int64)
        for at in range(0, len(rows), PIECE):
            part = pa.array(rows[at : at + PIECE])
            columns = [batch.column(c).take(part) for c in ("rep", "set", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes).take(part), pa.array(shingles[at : at + PIECE])], ["rep", "set", "label", "n", "shingle"])


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of different labels that can be similar enough, of ``sets`` (rep, label, shingles).

    A document with several rows has several sets; each has its own prefix.
    """
    each = sets.select("rep", "label", "shingles", F.xxhash64("shingles").alias("set")).dropDuplicates(["rep", "set"])
    tokens = each.mapInArrow(unpacked, "rep bigint, set bigint, label bigint, n bigint, shingle bigint")
    frequency = tokens.groupBy("shingle").agg(F.count("*").alias("docs"))
    place = F.row_number().over(Window.partitionBy("rep", "set").orderBy("docs", "shingle"))
    ranked = tokens.join(frequency, "shingle").withColumn("place", place)
    # A shingle of one document alone takes its place in the order, but joins nothing.
    first = ranked.filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("docs") > 1))
    first = stored(first.select("shingle", "rep", "label", "n", (F.col("n") - F.col("place")).alias("after")), "prefixes")
    # Pairs inside a shingle's most frequent component are never formed: one side of each pair is outside it.
    tally = first.groupBy("shingle", "label").agg(F.count("*").alias("times")).groupBy("shingle")
    open_ = tally.agg(F.max_by("label", F.struct("times", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    right = stored(first.join(open_, "shingle"), "open-prefixes")
    left = right.filter("label != main").drop("main").toDF("shingle", "a", "label_a", "n_a", "after_a")
    other = (F.col("label_a") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("a") > F.col("rep")))
    # What two sets can share from their first common shingle on must be enough.
    most = 1 + F.least("after_a", "after")
    enough = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n"))
    pairs = left.join(right, "shingle").filter(other & enough)
    return pairs.select(F.greatest("a", "rep").alias("a"), F.least("a", "rep").alias("b")).distinct()


def linked(percent: int):
    """Keeps the pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, right = None, None
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                left = np.frombuffer(a, np.uint64)
                if b != last:
                    last, right = b, np.frombuffer(b, np.uint64)
                small, large = sorted((len(left), len(right)))
                ok = 100 * small >= percent * large
                if ok:
                    at = np.searchsorted(right, left)
                    common = int(np.count_nonzero(right[np.minimum(at, len(right) - 1)] == left))
                    ok = 100 * common >= percent * (len(left) + len(right) - common)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) with every label lowered to the smallest one its component has.

    Minimum labels spread along the links and are then shortened by one jump to
    the label's own label, so long chains take few rounds.
    """
    both = stored(links.union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        # Every member of a component that hears something smaller tells its root.
        told = (
            labels.join(heard, labels["id"] == heard["a"])
            .groupBy("label").agg(F.min("heard").alias("lower"))
            .filter("lower < label")
        )
        told = stored(told, "lower")
        if told.isEmpty():
            return labels
        # A root may be told to follow one that itself follows another: jump until none does.
        while True:
            up = told.select(F.col("label").alias("lower"), F.col("lower").alias("next"))
            further = told.join(up, "lower", "left")
            if further.filter("next is not null").isEmpty():
                break
            told = stored(further.select("label", F.coalesce("next", "lower").alias("lower")), "lower")
        labels = stored(labels.join(told, "label", "left").select("id", F.coalesce("lower", "label").alias("label")), "labels")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest document id that links reach; ``kept`` marks
    that document. Texts are read whole. Null, empty and blank texts have no
    shingles and no links. Rows that repeat an id are one document (linked by
    any of their texts). Rows without id belong to no component and are kept:
    their ``component_id`` is null. An empty table gives an empty result; other
    columns are not looked at.
    """
    bodies = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("body"))
    sketch = stored(bodies.mapInArrow(sketches(shingle_words), SKETCH), "sketches")
    usable = sketch.filter("doc_id is not null and n_shingles > 0")
    # One representative for each set; a document with several rows links its sets.
    classes = stored(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    members = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    pivots = [F.min_by("rep", F.xxhash64("rep", "value", F.lit(k))).alias(f"pivot{k}") for k in range(PIVOTS)]
    hubs = members.groupBy("band", "value").agg(F.min("rep").alias("hub"), F.count("*").alias("n"), *pivots).filter("n > 1")
    buckets = stored(members.join(hubs, ["band", "value"]), "buckets")
    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = bodies.join(ids, "doc_id", "left_semi").mapInArrow(whole_sets(shingle_words), "doc_id bigint, shingles binary")
    sets = stored(sets, "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        return pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b").mapInArrow(linked(percent), "a bigint, b bigint")

    def labelled(name: str) -> DataFrame:
        return labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))

    labels = stored(usable.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("label")).distinct(), "labels")
    same = usable.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).filter("doc_id != rep")
    links = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    nearest = buckets.filter("hub < rep").groupBy(F.col("rep").alias("a")).agg(F.min("hub").alias("b"))
    labels = components(labels, links.union(confirm(nearest)))
    # Members that are still apart from one of their bucket's pivots, the hub first.
    for pivot in ("hub", *(f"pivot{k}" for k in range(PIVOTS))):
        asked = buckets.select("rep", pivot).distinct()
        apart = asked.join(labelled("rep"), "rep").join(labelled(pivot), pivot).filter(F.col("rep_label") != F.col(f"{pivot}_label"))
        labels = components(labels, confirm(apart.select(F.greatest("rep", pivot).alias("a"), F.least("rep", pivot).alias("b")).distinct()))

    def open_buckets() -> DataFrame:
        """Members of the buckets that are still not one component."""
        now = buckets.select("band", "value", "n", "rep").join(labelled("rep"), "rep")
        apart = now.groupBy("band", "value").agg(F.min("rep_label").alias("low"), F.max("rep_label").alias("high")).filter("low < high")
        return stored(now.join(apart.select("band", "value"), ["band", "value"]), "open-buckets")

    # Their members meet the most central one, which meets most others in its buckets.
    left = open_buckets()
    met = left.groupBy("rep").agg(F.sum("n").alias("met"))
    central = left.join(met, "rep").groupBy("band", "value").agg(F.max_by("rep", F.struct("met", "rep")).alias("centre"))
    asked = left.join(central, ["band", "value"]).select("rep", "rep_label", "centre").distinct()
    apart = asked.join(labelled("centre"), "centre").filter("rep_label != centre_label")
    labels = components(labels, confirm(apart.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()))
    # Of those still open, small ones compare every member with every other component's.
    left = open_buckets()
    small = left.filter(F.col("n") <= SMALL_BUCKET).drop("n")
    right = small.select("band", "value", F.col("rep").alias("b"), F.col("rep_label").alias("b_label"))
    rest = small.withColumnRenamed("rep", "a").join(right, ["band", "value"]).filter("a > b and rep_label != b_label").select("a", "b").distinct()
    labels = components(labels, confirm(rest))
    # The members of large ones meet by the rarest shingles of their sets.
    large = left.filter(F.col("n") > SMALL_BUCKET).select("rep").distinct()
    if not large.isEmpty():
        waiting = large.join(labelled("rep").withColumnRenamed("rep_label", "label"), "rep").join(sets, F.col("rep") == sets["doc_id"])
        labels = components(labels, confirm(prefix_pairs(waiting, percent)))
    result = sketch.join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, shingle_words, percent).filter("not kept").select("doc_id").distinct()
    name = free_name(docs, "gone_id")
    return docs.join(gone.withColumnRenamed("doc_id", name), col(id_col) == F.col(name), "left_anti")
