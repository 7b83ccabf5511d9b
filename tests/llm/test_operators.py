"""Operators against plain answers on small inputs with nulls, repeats, ties, blanks and extra columns."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from screenflow.llm import anchors, packing, phrases, quality, topk
from screenflow.llm.html import extract_text, main_text
from screenflow.llm.minmax import near_duplicates
from screenflow.llm.mixing import mix_sources
from screenflow.llm.packing import best_boundaries, pack
from screenflow.llm.phrases import remove_passages
from screenflow.llm.queries import QUERIES
from screenflow.llm.secrets import base_spans, redacted, scan_secrets
from screenflow.llm.suffix import remove_repeats
from screenflow.llm.topk import top_k
from screenflow.llm.urls import filter_urls
from tests.llm import brute

PASSAGE = "a passage of many words that several documents share from one end to the other without a change"
TEXTS = [
    (5, f"Start. {PASSAGE}. End of five."),
    (2, f"Two has it too: {PASSAGE}, and goes on."),
    (9, f"Start. {PASSAGE}. End of five."),
    (9, f"Start. {PASSAGE}. End of five."),
    (1, None), (3, ""), (4, " \n\t "), (6, "word"), (7, "WORD"), (8, "é" * 200),
    (10, "x " * 3000 + PASSAGE), (None, PASSAGE), (11, "é" * 190 + PASSAGE.upper()),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, q_kept string, copy string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, "b", "q", "c", "l") for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_suffix_array_dedup(docs, empty):
    got = remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert rows(got) == sorted(brute.op5(TEXTS), key=key)
    assert remove_repeats(empty).count() == 0


SAME_ID = [
    (1, PASSAGE), (2, "x" * 400 + PASSAGE), (2, "other text of the same document, which no earlier one has, from the first word to the last of it"), (2, "short"),
    (3, PASSAGE + " again"), (3, PASSAGE + " again"), (3, "once more " + PASSAGE), (2, None), (4, "y" * 60), (4, "z" + "y" * 70), (5, "y" * 55), (None, PASSAGE),
]


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_of_one_id_with_different_texts_keep_their_own(spark, parts):
    df = spark.createDataFrame(SAME_ID, "doc_id bigint, text string").repartition(parts)
    got = remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert rows(got) == sorted(brute.op5(SAME_ID), key=key)
    got = remove_passages(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert rows(got) == sorted(brute.op10(SAME_ID), key=key)


def test_a_passage_of_most_rows_does_not_fill_one_shard(spark):
    """Answers of a batch are spread by document: no shard gets more than a few times its share of them."""
    texts = [(i, f"{PASSAGE} and the end of number {i}") for i in range(3000)]
    bodies = spark.createDataFrame(texts, "doc_id bigint, body string").selectExpr("doc_id", "cast(body as binary) body").coalesce(1)
    packed = bodies.mapInArrow(anchors.find_pairs(phrases.RULE, 16), anchors.PAIRS).filter(F.col("state") == anchors.TOLD)
    sizes = [r["n"] for r in packed.groupBy("shard").agg(F.sum(F.length("docs")).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_phrase_automata(docs, empty):
    got = remove_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert rows(got) == sorted(brute.op10(TEXTS), key=key)
    assert remove_passages(empty).count() == 0


def test_passages_are_told_apart_where_their_hashes_are_equal(monkeypatch):
    """The automaton, not the hash, decides what recurs."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(phrases, "mixed", np.ones_like)
    base = [b"abcdefg"[i : i + 1] * (1 + i % 2) for i in rng.integers(0, 7, 60)]
    for _ in range(30):
        texts = [b" ".join([*base[a : a + 20], *(b"xy"[i : i + 1] for i in rng.integers(0, 2, 16))]) for a in rng.integers(0, 50, 9)]
        docs = rng.integers(-2, 5, 9)
        first: dict[tuple, int] = {}
        windows = [(j, i, tuple(t.split()[i : i + 13])) for j, t in enumerate(texts) for i in range(len(t.split()) - 12)]
        for j, _, w in windows:
            first[w] = min(first.get(w, docs[j]), docs[j])
        which, at = phrases.confirm(texts, docs, docs)
        assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == [(j, i) for j, i, w in windows if first[w] < docs[j]]


def test_minmax(docs, empty):
    want = [(d, n, c, True if k is None else k) for d, n, c, k in brute.op9(TEXTS)]
    assert rows(near_duplicates(docs, shingle_words=2)) == sorted(want, key=key)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("name", ["op5", "op9", "op10"])
def test_queries_on_the_given_table(spark, data, name):
    table = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    query = next(f for n, f in QUERIES.items() if n.startswith(f"{name}_"))
    assert rows(query(spark, data)) == sorted(getattr(brute, name)(table), key=key)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8).round(1)]) for i in range(150)]
    vectors += [(150, None), (151, [None] * 8), (152, [float("nan")] * 8), (None, [1.0] * 8), (7, vectors[7][1]), (153, vectors[3][1])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v and None not in v and not np.isnan(v).any()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        ranked = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    assert rows(top_k(df, df.filter("vec_id % 50 = 0"))) == sorted(want)
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_takes_every_row_of_a_repeated_id(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (2, [3.0, 1.0]), (2, [9.0, 9.0]), (3, [2.0, 2.0]), (0, [7.0, 7.0])], "vec_id bigint, embedding array<double>")
    got = rows(top_k(df, df.filter("vec_id % 50 = 0")))
    assert got == [(0, 1, 2, 18 * 65536), (0, 2, 2, 4 * 65536), (0, 3, 3, 4 * 65536)]


def test_top_k_over_many_blocks_and_lanes(spark, monkeypatch):
    """Every block of queries meets every index block once, in whatever lane; an index block is sent once a lane."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    vectors = [(i, [float((i * 7 + j * j) % 23 - 11) for j in range(2 + i % 2)]) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    want = []
    for q, v in vectors[::10]:
        ranked = sorted((-65536 * sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))[:5]
        want += [(q, r, i, -int(s)) for r, (s, i) in enumerate(ranked, 1)]
    assert rows(top_k(df, df.filter("vec_id % 10 = 0"))) == want


def test_boundaries_are_the_best():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = sorted(rng.choice(60, 9, replace=False).tolist())
        counts = rng.integers(1, 50, 9).tolist()
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in zip(sizes, counts, strict=True))
        best = min(cost([*c, sizes[-1]]) for c in itertools.combinations(sizes[:-1], 2))
        assert cost(best_boundaries(sizes, counts, 3)) == best


def test_pack_gives_texts_back(docs, empty):
    got = pack(docs, context=50, buckets=3, budget=200).collect()
    texts = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert "".join(texts[10]) == dict(TEXTS)[10]
    assert not {1, 3, 4} & set(texts)
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket"]
        batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(r["slot"])
    for (bucket, _, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= max(200, bucket)
    assert pack(empty).count() == 0


def test_equal_rows_are_spread_over_shards(spark, monkeypatch):
    """Half of the rows are copies of one: no shard gets much more than its share."""
    monkeypatch.setattr(packing, "SHARD_ROWS", 500)
    df = spark.createDataFrame([(1, "same text") if i % 2 else (i, f"text {i}") for i in range(10000)], "doc_id bigint, text string")
    sizes = [r["count"] for r in pack(df).groupBy("bucket", "shard").count().collect()]
    assert sum(sizes) == 10000 and len(sizes) == 20 and max(sizes) < 650


def test_mixing_is_repeatable(spark, docs, empty):
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    got = rows(mix_sources(docs, weights))
    assert got == rows(mix_sources(docs, weights)) and {r[3] for r in got} == {"s"}
    assert mix_sources(docs).columns[-2:] == ["_copy", "order_key"]
    assert mix_sources(empty).count() == 0


def test_rows_without_id_draw_one_by_one(spark):
    texts = [(None, f"text number {i}", "s") for i in range(1000)] + [(i, "x " * 40, "t") for i in range(100)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("s", 1.0), ("t", 1.0)], "source string, weight double")
    got = mix_sources(df, weights).filter("source = 's'").collect()
    size = sum(len(t) + 1 for d, t, _ in texts if d is None)
    rate = (size + 100 * 81) / 2 / size
    assert abs(len(got) - 1000 * rate) < 5 * (1000 * rate) ** 0.5
    assert len({r["order_key"] for r in got}) == len(got)


def test_quality_columns_and_rejects(docs, empty):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= {5, 2, 9, None, 11}
    assert quality.keep_good(empty).count() == 0


def _thresholds(spark, groups):
    """Thresholds by source; a group is a source and (documents, share of them with symbols)."""
    texts = [("en", s, "word " * 20 + ("| # " * 10 if i < n * part else "")) for s, (n, part) in groups.items() for i in range(n)]
    return {r["q_source"]: r for r in quality.thresholds(spark.createDataFrame(texts, "lang string, source string, text string")).collect()}


def test_thresholds_follow_the_source_and_move_smoothly(spark):
    got = _thresholds(spark, {"code": (400, 0.95), "prose": (4000, 0.0), "some": (400, 0.05), "little code": (20, 0.95)})
    assert got["prose"]["q_max_symbols"] <= got["some"]["q_max_symbols"] < got["little code"]["q_max_symbols"] < got["code"]["q_max_symbols"]
    sizes = [60, 99, 100, 101, 140]
    limits = [_thresholds(spark, {"code": (n, 0.95), "prose": (900, 0.0)})["code"]["q_max_symbols"] for n in sizes]
    assert limits == sorted(limits) and limits[3] - limits[1] <= 4 < limits[4] - limits[0]


def test_sketch_buckets(spark):
    values = [*range(200), 1000, 4095, 4096, 10**6]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", quality.bucket(F.col("v")).alias("b")).withColumn("top", quality.bucket_top(F.col("b"))).collect()
    assert all(r["v"] <= r["top"] <= r["v"] * 17 / 16 for r in got)


def test_secrets(docs, empty, spark):
    key_, noise = "AKIA" + "B7" * 9, "q7Zk1VtR9xWm3LpYc8Hd2NfJs6Gb0TeQ"
    text = f'pass: Token = "abcdefghijkl" {key_} 0123456789abcdef01 {noise} plainwordsarehere'
    assert [k for k, *_ in base_spans(text)] == ["assign", "access", "hex"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] for r in scan_secrets(df).collect()}
    assert got[2] == got[3] == [] and ("random", noise) in got[1] and len(got[1]) == 4
    assert redacted("ab SECRET c", [("hex", 3, 9), ("assign", 3, 7)]) == "ab [assign removed] c"
    assert scan_secrets(empty).count() == 0 and scan_secrets(docs).count() == len(TEXTS)


def test_html(spark):
    page = (
        "<body><header>Site</header><nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>One\n two&nbsp;<b>three</b><br>four"
        "<p>Short.<aside>Side</aside><form>Form</form><ul><li><a href=y>link list</a></ul><div class='comments'><p>Reader</div></article>"
        "<div class=ad>Buy</div><footer>&copy; Foot</footer><script>var t='</p>';</script>"
    )
    assert main_text(page) == "Title & more\n\nOne two three four\n\nShort."
    plain = "<div>Menu</div><p>" + "This is the text of an article that is long enough and has the words that we need in it. " * 3 + "<p>Yes.<p>And so it goes on with the words of the text, which is long enough to be read by all of you here, as it should be."
    assert "Yes." in main_text(plain)
    assert main_text(None) == main_text("") == main_text("<p") == ""
    df = spark.createDataFrame([(1, None, "x"), (2, page, "x")], "page_id bigint, html string, text string")
    assert extract_text(df).columns == ["page_id", "text"]


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("bad.example.com", "a", "2024-01-05", "add"), ("bad.example.com", "a", "2024-01-09", "remove"), ("example.org", "b", "2024-01-02", "add"), (None, "b", "2024-01-02", "add")],
        "key string, list string, dated string, action string",
    ).withColumn("dated", F.col("dated").cast("date"))
    captures = spark.createDataFrame(
        [(1, "http://bad.example.com/x", "2024-01-04"), (2, "http://bad.example.com/x", "2024-01-05"), (3, "https://u@BAD.example.com:80/", "2024-01-09"),
         (4, "http://a.b.example.org", "2024-03-01"), (5, None, "2024-03-01"), (6, "http://a.b.example.org", None), (2, "http://bad.example.com/x", "2024-01-05")],
        "page_id bigint, url string, day string",
    ).withColumn("fetched_on", F.col("day").cast("date"))
    got = rows(filter_urls(captures, entries).select("page_id", F.array_join("lists", ","), "blocked"))
    assert got == [(1, "", False), (2, "a", True), (2, "a", True), (3, "", False), (4, "b", True), (5, "", False), (6, "", False)]
    assert not any(r["blocked"] for r in filter_urls(captures, entries.limit(0)).collect())


def test_pipeline_stages(spark, docs, empty):
    for start in (docs, empty):
        table = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "unused")
            if name != "packing":
                assert out.columns == start.columns
            table = out
        assert table.count() >= 0
