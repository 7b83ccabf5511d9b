"""Buckets above the size whose members are compared directly."""

import random

import pytest

from screenflow.llm import minmax
from screenflow.llm.minmax import near_duplicates
from tests.llm import brute


@pytest.mark.parametrize("pivots", [0, 3])
def test_large_buckets_lose_no_link(spark, monkeypatch, pivots):
    monkeypatch.setattr(minmax, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minmax, "PIVOTS", pivots)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(80), rng.randrange(1, 9)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    # Two rows of one id, with different texts and with the same one.
    rows += [(5, rows[60][1]), (7, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in near_duplicates(df, shingle_words=2).collect())
    assert got == sorted(brute.op9(rows))
    assert len({r[2] for r in got}) > 3
