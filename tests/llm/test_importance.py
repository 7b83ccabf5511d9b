"""Resampling against plain counting."""

from __future__ import annotations

import pytest

from screenflow.llm.importance import PIECE, buckets_of, drawn, gram_pattern, resample
from screenflow.llm.queries import op13_importance_resampling
from tests.llm import brute


def rows(df):
    return ordered(tuple(r) for r in df.collect())


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


def test_query_on_the_given_tables(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert rows(op13_importance_resampling(spark, data)) == ordered(brute.op13(docs, target))


@pytest.mark.parametrize("max_words", [1, 2, 3])
def test_nulls_blanks_repeats_ties_and_clashing_names(spark, max_words):
    text = "Déjà vu: the QUICK brown_fox 42 jumps\x00over\nthe lazy-dog's back, again & again — ßeta "
    docs = [(i, text * (i % 5)) for i in range(40)]
    docs += [(5, "another text of the same id " * 9), (6, docs[6][1]), (None, text * 4), (None, None), (50, None), (51, ""), (52, " .,;\n"), (53, "日本語 テキスト " * 30)]
    target = [text, None, "", "lazy dog lazy dog"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, packed string, rank int")
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample(df, bench, max_words=max_words, buckets=300, percent=30, least_words=9)
    want = brute.op13(docs, target, max_words, 300, 30, 9)
    assert rows(got) == ordered(want)
    taken = {r[0] for r in want if r[4] is not None and r[0] is not None}
    kept = drawn(df, bench, max_words=max_words, buckets=300, percent=30, least_words=9)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == taken
    assert resample(df.limit(0), bench).count() == 0
    assert rows(resample(df, bench.limit(0), max_words=max_words)) == ordered(brute.op13(docs, [], max_words))


def test_overlapped_spans_across_pieces():
    words = [f"Wörd{i % 101}" for i in range(PIECE // 5)]
    text = ", ".join(words)
    for size in (1, 2, 3):
        patterns = [gram_pattern(n) for n in range(1, size + 1)]
        n_words, found = buckets_of(text.encode(), patterns, 977)
        (want_words, want), = [features(text, size)]
        assert n_words == want_words and len(text.encode()) > PIECE
        assert sorted(found) == sorted(want.elements())


def features(text, size):
    import re
    import zlib
    from collections import Counter

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 977 for n in range(1, size + 1) for i in range(len(words) - n + 1))
