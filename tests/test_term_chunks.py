"""A large lexicon met by chunks gives what it gives row by row, and moves little more than the texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from screenflow.lexicon import MENTAL_HEALTH
from screenflow.operators import term_chunks, term_join
from screenflow.operators.score import TermTableScorer
from screenflow.operators.signals import signal_scores
from screenflow.operators.term_join import TermTable, match_terms, score_matches
from screenflow.sources.scratch import shuffles_dropped
from screenflow.spec import CLASSIFY, SCREEN, Settings
from workloads import views

TERMS = "signal string, term string, screen int, classify int, weight double"
FIELDS = "description string, transcript string, suggested_words string"


def shuffled_bytes(df):
    """What the exchanges of a query that ran have moved, before compression."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.fixture
def chunked(monkeypatch):
    """Every lexicon counts as a large one, and few texts make up several chunks and buckets."""
    monkeypatch.setattr(term_join, "MAX_FIRST_WORDS", 0)
    monkeypatch.setattr(term_chunks, "LEAST_BYTES", 1)
    monkeypatch.setattr(term_chunks, "BUCKET_TERMS", 20)


def test_what_moves_does_not_grow_with_the_matches(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(200)]
    pairs = {f"{a} {b}" for t in texts for a, b in zip(t.split(), t.split()[1:], strict=False)}
    table = TermTable.store(spark.createDataFrame([("s", t, 1, -1, 0.5) for t in [*words, *sorted(pairs)[::3]]], TERMS))
    rows = spark.createDataFrame([(f"video number {i}", t) for i, t in enumerate(texts)], "url string, description string").repartition(4)
    matched = match_terms(rows, table).select("url", "_support_screen")
    got = matched.collect()
    known = {*words, *sorted(pairs)[::3]}
    want = {f"video number {i}": 0.5 * len(known & ({*t.split()} | {f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False)})) for i, t in enumerate(texts)}
    assert {r["url"]: r["_support_screen"] for r in got} == want
    # With a row for each match, or each run that may be a term, it was 17 times the texts.
    assert shuffled_bytes(matched) < 6 * sum(map(len, texts))


@pytest.mark.parametrize("stage", ["screen", "classify"])
def test_chunks_score_as_literals(spark, chunked, stage):
    rng = random.Random(9)
    tags = ["#anxietyawareness", "#adhdtok", "#dog", "#selfharm", "#mentalhealthawareness", "#adhd_x", "#notaword", "#adhd", "#", "#bipolardisorder"]
    words = [*MENTAL_HEALTH.terms(), *tags, "♪", "so", "ocd", "my", "ÄNGSTE", "日本"] + ["w"] * 40

    def text():
        if rng.random() < 0.2:
            return rng.choice([None, "", "  ", "#", "##", "--"])
        return "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(rng.randrange(25)))

    data = [(f"u{i % 300}", text(), text(), text(), i) for i in range(400)]
    data += [(None, "adhd", None, None, 400), (None, "#ocdawareness", None, None, 401), data[3][:4] + (402,)]
    rows = spark.createDataFrame(data, f"url string, {FIELDS}, id int").repartition(4)
    terms = [(s.name, t, s.screen, s.classify, s.weight) for s in MENTAL_HEALTH.signals for t in s.terms]
    tag_words = spark.createDataFrame([(w,) for w in MENTAL_HEALTH.tag_words], "word string")
    table = TermTable.store(spark.createDataFrame(terms, TERMS), MENTAL_HEALTH.hashtag_signal, tag_words)
    assert table.sieve is not None
    want = {r["id"]: r for r in signal_scores(rows, MENTAL_HEALTH, stage, 2.0).collect()}
    got = score_matches(match_terms(rows, table), table, stage, 2.0).collect()
    assert len(got) == len(data)
    for r in got:
        w = want[r["id"]]
        assert (r["label"], r["rationale"], r["support"], r["against"]) == (w["label"], w["rationale"], w["support"], w["against"]), data[r["id"]]
        assert r["prob_true"] == pytest.approx(w["prob_true"])


def test_entries_and_nulls_as_by_rows(spark, chunked, monkeypatch):
    terms = [
        ("s", "sad", 1, -1, None), ("s", "low", 1, 1, 3.0), ("t", "low", 1, 1, 0.5), ("t", "low", -1, 1, 3.0), ("s", "odd", None, 1, 1.0),
        ("s", "low sad day", 1, 0, 0.25), ("t", "four words in all", 2, 1, 1.0), (None, "day", -1, None, 0.75), ("s", "sad day", 0, -1, -1.5),
    ]
    texts = ["sad low", "low odd", "low", "low sad day sad day", "four words in all", "four words in", "day four", "--", None, "low sad. DAY; low"]
    rows = spark.createDataFrame([(f"u{i % 30}", texts[i % 10], texts[i % 7], texts[i % 9]) for i in range(240)], f"url string, {FIELDS}").repartition(3)
    table, settings = spark.createDataFrame(terms, TERMS), Settings("m", "m")

    def label(lexicon):
        return sorted(map(str, TermTableScorer(lexicon).label_stages(rows, [SCREEN, CLASSIFY], settings).collect()))

    many = TermTable.store(table)
    got = label(many)
    monkeypatch.setattr(term_join, "MAX_FIRST_WORDS", 1_000)
    few = TermTable.store(table)
    assert (many.sieve is None, few.sieve is None) == (False, True)
    assert got == label(few) and len(got) == 480
    assert len(TermTableScorer(many).label(rows.limit(0), SCREEN, settings).collect()) == 0


def test_the_sieve_lets_every_term_through(spark, monkeypatch):
    monkeypatch.setattr(term_chunks, "BLOCK_BITS", 10)
    terms = [f"a{i}" for i in range(3000)] + [f"b{i} c{i % 7}" for i in range(3000)] + [f"é{i} 日本 c{i % 7}" for i in range(500)]
    bits, body = term_chunks.sieve_of(spark.createDataFrame([(t,) for t in terms], "term string").repartition(3), len(terms))
    on = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
    assert len(on) == 1 << bits and on[term_chunks.slots_of(term_chunks.term_hashes(pa.array(terms)), bits)].all()
    assert on.mean() < 0.1


def test_packed_terms_come_back():
    numbers = [pa.array([1.5, None, -2.0]), pa.array([None, 1, -1], pa.int32())]
    body = term_chunks.packed(pa.array(["b c", "a", "é"]), numbers)
    assert term_chunks.unpacked(body, ["x", "y"]).to_pylist() == [
        {"term": "a", "x": None, "y": 1.0}, {"term": "b c", "x": 1.5, "y": None}, {"term": "é", "x": -2.0, "y": -1.0},
    ]


def test_shuffles_of_a_stored_lexicon_are_dropped_and_the_setting_restored(spark, conf):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf(name, "false")
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == "false"


def test_terms_of_a_corpus(spark, tmp_path):
    texts = [None, "", "--", "One two, TWO three", "a b", "École été; one two three four", " lead and trail. ", "x" * 3]
    for k, name in enumerate(("documents", "conversations", "benchmark")):
        spark.createDataFrame([(t,) for t in texts[k:]], "text string").write.parquet(f"{tmp_path}/{name}.parquet")

    def runs(of, n):
        for t in of:
            w = re.findall(r"[^\W_]+", (t or "").lower())
            yield from (" ".join(w[i : i + n]) for i in range(len(w) - n + 1))

    want = sorted({t for k in range(3) for t in runs(texts[k:], k + 1) if len(t) > 2})
    assert sorted(r["term"] for r in views.corpus_terms(spark, str(tmp_path)).collect()) == want
