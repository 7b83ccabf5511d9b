"""SimHash groups against all pairs, and what the pivot tables promise."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenflow.llm.queries import op11_pivot_simhash
from screenflow.llm.simhash import PivotTable, fingerprint, print_links, simhash_duplicates
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, print string, label string, component_id string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def hexed(df):
    return df.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")), "component_id")


def test_query_on_the_given_table(spark, data):
    table = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op11_pivot_simhash(spark, data)) == rows_of(brute.op11(table))


def rows_of(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


def test_nulls_blanks_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [
        (9, long), (4, long + " and a tail"), (4, "quite another text than the first of this id"), (7, "quite another text than the first of this id"),
        (3, None), (5, ""), (6, " \n\t"), (8, "One Two"), (2, "one\ntwo"), (None, long), (None, None), (11, "a b c"), (12, "É é É"),
    ]
    df = spark.createDataFrame([(d, t, "p", "l", "c") for d, t in texts], SCHEMA)
    got = simhash_duplicates(df, shingle_words=3)
    assert rows(hexed(got)) == rows_of(brute.op11(texts))
    kept = {(r["doc_id"], r["kept"]) for r in got.collect()}
    assert {(3, True), (5, False), (None, True)} <= kept
    assert simhash_duplicates(df.limit(0)).count() == 0


def test_very_long_text_in_pieces():
    words = [f"W{i % 977}x{i % 13}" for i in range(250_000)]
    text = "\t ".join(words)
    assert len(text) > 1 << 20
    assert fingerprint(text.encode(), 3) == brute.simhash(text, 3)
    assert fingerprint(b"x" * (3 << 20), 3) == brute.simhash("x" * (3 << 20), 3)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_are_all_pairs_within_the_bits(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(c) for c in centres]
    for c in centres.tolist():
        near += [c ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(1, 6, 12)]
    near += [0, 1, 3, (1 << 64) - 1, 1 << 63]
    prints = np.array(sorted(set(near)), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print bigint")
    got = [tuple(sorted(np.array(tuple(r), np.int64).view(np.uint64).tolist())) for r in print_links(df, bits).collect()]
    all_pairs = np.bitwise_count(prints[:, None] ^ prints[None, :])
    i, j = np.nonzero(np.triu(all_pairs <= bits, 1))
    assert len(got) == len(set(got)), "each link once"
    assert set(got) == {tuple(sorted((int(prints[a]), int(prints[b])))) for a, b in zip(i, j, strict=True)}


def test_bounds_never_exceed_the_distance_and_discard_nearly_all():
    table = PivotTable(2)
    values = np.arange(256, dtype=np.uint8)
    true = np.bitwise_count(values[:, None] ^ values[None, :])
    assert (table.bound <= true[None]).all()
    far = true > 2
    assert (table.bound[:, far] > 2).mean() > 0.9


def test_one_family_of_near_copies_stays_in_small_buckets(spark):
    """Thousands of fingerprints around one centre: no bucket holds a large share of them."""
    rng = np.random.default_rng(8)
    prints = {0}
    while len(prints) < 3000:
        prints.add(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    table = PivotTable(2)
    keys = table.keys(np.array(sorted(prints), np.uint64))
    _, sizes = np.unique(keys, return_counts=True)
    assert sizes.max() <= 256
