"""A lexicon as a table gives what the same lexicon gives as literals, at any size."""

import random

import pytest
from pyspark.sql import functions as F

from screenflow.functions.hashtags import break_words, compound_parts
from screenflow.lexicon import MAX_TERMS, MENTAL_HEALTH
from screenflow.operators.score import SignalScorer, TermTableScorer
from screenflow.operators.signals import signal_scores
from screenflow.operators import term_join
from screenflow.operators.term_join import TermTable, match_terms, normal_terms, runs_of, score_matches
from screenflow.spec import CLASSIFY, SCREEN, Settings
from tests.conftest import optimized

TERMS = "signal string, term string, screen int, classify int, weight double"
FIELDS = "description string, transcript string, suggested_words string"


def term_rows(lexicon):
    return [(s.name, t, s.screen, s.classify, s.weight) for s in lexicon.signals for t in s.terms]


@pytest.fixture(scope="module")
def stored(spark):
    words = spark.createDataFrame([(w,) for w in MENTAL_HEALTH.tag_words], "word string")
    return TermTable.store(spark.createDataFrame(term_rows(MENTAL_HEALTH), TERMS), MENTAL_HEALTH.hashtag_signal, words)


@pytest.mark.parametrize("stage", ["screen", "classify"])
def test_same_scores_as_literals(spark, stored, stage):
    rng = random.Random(5)
    tags = ["#anxietyawareness", "#adhdtok", "#dog", "#selfharm", "#mentalhealthawareness", "#adhd_x", "#notaword", "#adhd", "#", "#bipolardisorder"]
    words = [*MENTAL_HEALTH.terms(), *tags, "♪", "so", "ocd", "my"] + ["w"] * 40

    def text():
        if rng.random() < 0.2:
            return rng.choice([None, "", "  ", "#", "##"])
        return "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(rng.randrange(25)))

    data = [(f"u{i % 300}", text(), text(), text(), i) for i in range(400)]
    data += [(None, "adhd", None, None, 400), (None, "#ocdawareness", None, None, 401), data[3][:4] + (402,)]
    rows = spark.createDataFrame(data, f"url string, {FIELDS}, id int").repartition(4)
    want = {r["id"]: r for r in signal_scores(rows, MENTAL_HEALTH, stage, 2.0).collect()}
    got = score_matches(match_terms(rows, stored), stored, stage, 2.0).collect()
    assert len(got) == len(data)
    for r in got:
        w = want[r["id"]]
        assert (r["label"], r["rationale"], r["support"], r["against"]) == (w["label"], w["rationale"], w["support"], w["against"]), data[r["id"]]
        assert r["prob_true"] == pytest.approx(w["prob_true"])


def test_more_terms_than_literals_allow(spark):
    terms = spark.range(3 * MAX_TERMS).select(
        F.lit("s").alias("signal"), F.concat_ws(" ", F.lit("Term"), F.col("id").cast("string"), F.lit("end")).alias("term"),
        F.lit(1).alias("screen"), F.lit(1).alias("classify"), F.lit(1.0).alias("weight"),
    )
    table = TermTable.store(terms)
    rows = spark.createDataFrame([("a", "one term 59999 end"), ("b", "term 59999 - x end"), ("c", "TERM 7\nEND, term 8 end"), ("d", None)], "url string, description string")
    scored = TermTableScorer(table).label(rows, CLASSIFY, Settings("m", "m"))
    assert {r["url"]: (r["label"], r["rationale"]) for r in scored.collect()} == {
        "a": ("FALSE", "signals: term 59999 end"), "b": ("FALSE", None), "c": ("TRUE", "signals: term 7 end, term 8 end"), "d": ("FALSE", None),
    }
    assert table.lengths == (3,)
    assert "59999" not in optimized(scored), "no term is in the plan"
    empty = TermTable.store(terms.limit(0))
    assert {r["label"] for r in TermTableScorer(empty).label(rows, SCREEN, Settings("m", "m")).collect()} == {"FALSE"}


def test_terms_are_normalised_and_checked(spark):
    rows = [("s", "C-PTSD", 1, 1, 1.0), ("s", "c ptsd", 1, 1, 1.0), ("t", "ÄNGSTE", 1, 0, 0.5)]
    got = {(r["signal"], r["term"], r["n_words"]) for r in normal_terms(spark.createDataFrame(rows, TERMS)).collect()}
    assert got == {("s", "c ptsd", 2), ("t", "ängste", 1)}
    for bad in ("--", None):
        with pytest.raises(Exception, match="neither letters nor digits"):
            normal_terms(spark.createDataFrame([("s", bad, 1, 1, 1.0)], TERMS)).collect()


def test_large_terms_join_without_a_broadcast(spark, stored, conf):
    rows = spark.createDataFrame([(f"u{i}", "adhd and my diagnosis " * (i % 4), None, None) for i in range(50)], f"url string, {FIELDS}")
    want = sorted(tuple(r) for r in TermTableScorer(stored).label(rows, CLASSIFY, Settings("m", "m")).collect())
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    assert sorted(tuple(r) for r in TermTableScorer(stored).label(rows, CLASSIFY, Settings("m", "m")).collect()) == want


def test_both_stages_meet_the_terms_once(spark, stored):
    texts = ["adhd and my diagnosis", "#adhdawareness ocd", None, "my adhd my adhd"]
    rows = spark.createDataFrame([(f"u{i % 5}", texts[i % 4], texts[i % 3], None) for i in range(24)], f"url string, {FIELDS}")
    scorer, settings = TermTableScorer(stored), Settings("m", "m")
    both = scorer.label_stages(rows, [SCREEN, CLASSIFY], settings)
    want = [(r["url"], s.name, *tuple(r)[1:]) for s in (SCREEN, CLASSIFY) for r in scorer.label(rows, s, settings).collect()]
    assert sorted(map(str, (tuple(r) for r in both.collect()))) == sorted(map(str, want))
    assert optimized(both).count("Join Inner, (term#") == 1


def test_a_text_that_holds_every_term(spark):
    """Entries are summed in flat rows: no array of them is compared with itself."""
    n = 5000
    terms = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("signal"), F.concat(F.lit("w"), F.col("id")).alias("term"), F.lit(1).alias("screen"),
        F.when(F.col("id") % 4 == 0, -1).otherwise(1).alias("classify"), F.lit(0.5).alias("weight"),
    )
    table = TermTable.store(terms.union(terms.withColumn("signal", F.lit("more")).limit(2)))
    text = " ".join(f"w{i}" for i in range(n))
    matched = match_terms(spark.createDataFrame([("a", text, text, text)], f"url string, {FIELDS}"), table)
    assert "struct" not in matched.drop("url").schema.simpleString().removeprefix("struct")
    [r] = score_matches(matched, table, "classify", 2.0).collect()
    assert (r["support"] + r["against"], r["against"]) == ((n + 2) * 0.5, n // 4 * 0.5 + 0.5)
    assert len(r["rationale"].split(", ")) == n - n // 4


def test_an_unknown_weight_makes_the_sum_nothing(spark):
    table = TermTable.store(spark.createDataFrame([("s", "sad", 1, -1, None), ("s", "low", 1, 1, 3.0), ("s", "odd", None, 1, 1.0)], TERMS))
    rows = spark.createDataFrame([("a", "sad low", None, None), ("b", "low odd", None, None), ("c", "low", None, None)], f"url string, {FIELDS}")
    got = score_matches(match_terms(rows, table), table, "screen", 1.0).collect()
    assert {r["url"]: (r["support"], r["against"], round(r["prob_true"], 3)) for r in got} == {
        "a": (0.0, 0.0, 0.378), "b": (3.0, 0.0, 0.378), "c": (3.0, 0.0, 0.996),
    }


def test_only_runs_that_may_be_terms_are_formed(spark, monkeypatch):
    terms = [("s", t, 1, 1, 1.0) for t in ("sad", "mental health", "mental state of mind", "state of")]
    rows = spark.createDataFrame([("a", "a mental state of mind, sad; a state of mental", None, None), ("b", "mental", None, None)], f"url string, {FIELDS}")
    few = TermTable.store(spark.createDataFrame(terms, TERMS))
    words = rows.select(F.split("description", "[^a-z]+").alias("w"))
    formed = [words.select(F.array_compact(runs_of("w", few, n))).first()[0] for n in few.lengths]
    assert formed == [["sad"], ["mental state", "state of", "state of"], ["mental state of mind"]]
    monkeypatch.setattr(term_join, "MAX_FIRST_WORDS", 0)
    many = TermTable.store(spark.createDataFrame(terms, TERMS))
    assert len(words.select(F.array_compact(runs_of("w", many, 2))).first()[0]) == 9
    got = [sorted(map(tuple, TermTableScorer(t).label(rows, CLASSIFY, Settings("m", "m")).collect())) for t in (few, many)]
    assert got[0] == got[1] and got[0][0][3] == "signals: mental state of mind, sad, state of"


def ways(text, words):
    """Every way to cut ``text`` into words."""
    if not text:
        return [[]]
    return [[w, *rest] for w in words if text.startswith(w) for rest in ways(text[len(w) :], words)]


def test_breaking_words_against_all_ways(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "abb", "baab", "é", "éa", "cc"]
    texts = ["".join(rng.choice("abéc") for _ in range(rng.randrange(12))) for _ in range(300)] + ["ab" * 40, "x", ""]
    known = F.split(F.lit(" ".join(words)), " ")
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = df.select("t", break_words(F.col("t"), lambda w: F.array_contains(known, w), 4).alias("p")).collect()
    for r in got:
        if len(r["t"]) < 30:
            best = sorted((w for w in ways(r["t"], words) if w), key=lambda w: (len(w), [-len(x) for x in reversed(w)]))
            assert r["p"] == (best[0] if best else []), r["t"]
        else:
            assert "".join(r["p"]) == r["t"]


def test_compound_tag_counts_for_its_condition(spark):
    rows = spark.createDataFrame(
        [(t, None, None) for t in ("look #adhdawareness", "#MentalHealthAwareness", "#adhdxyz", "#dogawareness", "#awarenessmonth", "#adhd #ocdtok")], FIELDS
    )
    got = [r["rationale"] for r in SignalScorer().label(rows, SCREEN, Settings("m", "m")).collect()]
    assert got == ["signals: adhd", "signals: mental health awareness", None, None, None, "signals: adhd, ocd"]
    one = spark.createDataFrame([("adhd",), ("adhdawareness",), (None,)], "t string")
    known = F.split(F.lit("adhd awareness"), " ")
    parts = compound_parts(F.col("t"), lambda w: F.array_contains(known, w), 9)
    assert [r[0] for r in one.select(parts).collect()] == [[], ["adhd", "awareness"], []]


def test_a_compound_condition_among_many_tags_is_still_a_lone_one(spark):
    rows = spark.createDataFrame([("#adhdtok #dog #cat #fun #summer", "", "adhd tips"), ("#adhdtok #ocd #cat #fun #summer", "", "adhd tips")], FIELDS)
    assert [r["label"] for r in SignalScorer().label(rows, CLASSIFY, Settings("m", "m")).collect()] == ["FALSE", "TRUE"]
