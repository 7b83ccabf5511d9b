import math
import random
import re

import pytest
from pyspark.sql import functions as F

from screenflow.lexicon import MENTAL_HEALTH, Lexicon, Signal, lexicon_from_table
from screenflow.operators.score import SignalScorer
from screenflow.operators.signals import FEW_STEMS, find_terms, signal_scores
from screenflow.plans.cascade import signal_cascade
from screenflow.spec import CLASSIFY, SCREEN, TEXT_COLS, Settings
from tests.conftest import optimized, plan_of
from workloads import views
from workloads.models import INSULTS, SCORER

FIELDS = "description string, transcript string, suggested_words string"
CASES = [
    # description, transcript, suggested words, screen, classify
    ("living with #ADHD and anxiety", "my diagnosis changed things", None, "TRUE", "TRUE"),
    ("a day at the beach", "waves", "beach", "FALSE", "FALSE"),
    ("I saw my therapist", None, None, "TRUE", "FALSE"),
    ("that is so depressing, so OCD", None, None, "FALSE", "FALSE"),
    ("retail therapy", None, None, "FALSE", "FALSE"),
    ("", "♪ depression and anxiety all over me ♪", "song", "FALSE", "FALSE"),
    ("bipolar", "(Music) la la", "depression help", "TRUE", "TRUE"),
    ("bipolar", "", "depression help", "TRUE", "TRUE"),
    ("bipolar", "some speech", "nothing", "TRUE", "FALSE"),
    ("#anxiety #dog #cat #fun #summer", "", "anxiety tips", "TRUE", "FALSE"),
    ("Self-Harm recovery and psychotherapy", None, None, "TRUE", "TRUE"),
    ("chemotherapy and chronic pain", None, None, "FALSE", "FALSE"),
    ("PTSD from this lol", None, None, "FALSE", "FALSE"),
    (None, None, None, "FALSE", "FALSE"),
]


def test_default_lexicon(spark):
    rows = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)], f"id int, {FIELDS}, s string, c string"
    )
    scorer = SignalScorer()
    for stage, want in ((SCREEN, "s"), (CLASSIFY, "c")):
        for r in scorer.label(rows, stage, Settings("m", "m")).collect():
            assert r["label"] == r[want], (stage.name, CASES[r["id"]])


def brute_force(row, lexicon, stage, threshold):
    """The rules once more, in plain Python."""
    found = {}
    silent = True
    for field in TEXT_COLS:
        low = (row[field] or "").lower()
        tokens = re.split(r"[\W_]+", low)
        line = " " + " ".join(tokens) + " "
        terms = {t for t in lexicon.terms() if f" {t} " in line}
        if field == "transcript":
            lyrics = any(m in low for m in ("♪", "♫", "(singing)", "(music)"))
            silent = lyrics or not low.strip()
            terms = set() if lyrics else terms
        found[field] = terms
    union = set().union(*found.values())

    def side(sign):
        return sum(
            s.weight * len(union & set(s.terms)) for s in lexicon.signals if s.polarity(stage) == sign
        )

    evidence = sum(
        (2.0 if f == "description" else 1.0) * s.weight * s.polarity(stage) * len(t & set(s.terms))
        for f, t in found.items()
        for s in lexicon.signals
    )
    support, against = side(1), side(-1)
    positive = set(lexicon.terms(stage, 1))
    if stage == "screen":
        passes = support >= threshold and support >= against
    else:
        agreeing = sum(bool(t & positive) for t in found.values())
        passes = support - against >= threshold or (
            silent and agreeing >= 2 and support > against
        )
        if lexicon.hashtag_signal:
            tags = re.findall(r"#(\w+)", (row["description"] or "").lower())
            words = set(lexicon.signal(lexicon.hashtag_signal).words)
            if len(tags) >= 5 and len(words & set(tags)) == 1 and len(union & positive) == 1:
                passes = False
    hits = sorted(union & positive)
    return (
        "TRUE" if passes else "FALSE",
        1 / (1 + math.exp(threshold - 0.5 - evidence)),
        "signals: " + ", ".join(hits) if hits else None,
    )


SMALL = Lexicon(
    (Signal("s", ("anxiety", "so ocd", "cat")), Signal("n", ("dog",), -1, 0, 0.5)), "s"
)


@pytest.mark.parametrize("lexicon", [MENTAL_HEALTH, SMALL], ids=["large", "small"])
@pytest.mark.parametrize("stage", ["screen", "classify"])
def test_rules_against_brute_force(spark, lexicon, stage):
    rng = random.Random(11)
    words = [*lexicon.terms(), "#anxiety", "#dog", "x", "étrash", "♪", "Cat-", "so", "ocd"] + ["w"] * 30
    gaps = [" ", " ", "\n", ", ", "-"]

    def text():
        if rng.random() < 0.2:
            return rng.choice([None, "", "  "])
        return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(25)))

    data = [(i, text(), text(), text()) for i in range(600)]
    rows = spark.createDataFrame(data, f"id int, {FIELDS}")
    got = {r["id"]: r for r in signal_scores(rows, lexicon, stage, 2.0).collect()}
    for r in rows.collect():
        label, prob, rationale = brute_force(r, lexicon, stage, 2.0)
        g = got[r["id"]]
        assert (g["label"], g["rationale"]) == (label, rationale), r
        assert g["prob_true"] == pytest.approx(prob)


def test_terms_of_any_script(spark):
    lexicon = Lexicon((Signal("s", ("Self-harm", "C-PTSD", "Ängste", "тревога", "covid19")),))
    assert lexicon.signals[0].terms == ("self harm", "c ptsd", "ängste", "тревога", "covid19")
    texts = ["my self-harm", "C-PTSD!", "ÄNGSTE", "о тревога.", "#covid19", "angste", "covid 19", "selfharm"]
    rows = spark.createDataFrame([(t,) for t in texts], "description string")
    got = [r["label"] for r in signal_scores(rows, lexicon, "screen", 1.0).collect()]
    assert got == ["TRUE"] * 5 + ["FALSE"] * 3
    with pytest.raises(ValueError, match="neither letters nor digits"):
        Signal("s", ("--",))


def test_both_tokenising_paths_are_covered():
    def stems(lexicon):
        return len({max(t.split(" "), key=len) for t in lexicon.terms()})

    assert stems(MENTAL_HEALTH) > FEW_STEMS >= stems(SMALL)


def test_missing_fields_are_ignored(spark):
    rows = spark.createDataFrame([("anxiety and adhd",)], "description string")
    assert signal_scores(rows, MENTAL_HEALTH, "classify", 2.0).first()["label"] == "TRUE"


def test_lexicon_from_table(spark):
    table = spark.createDataFrame(
        [("a", "X y", 1, 1, 1.0), ("a", "z", 1, 1, 1.0), ("b", "w", -1, 0, 2.0)],
        "signal string, term string, screen int, classify int, weight double",
    )
    assert lexicon_from_table(table).signals == (
        Signal("a", ("x y", "z")), Signal("b", ("w",), -1, 0, 2.0)
    )


def test_cascade_is_one_scan(spark, data):
    wide = signal_cascade(views.videos(spark, data), [(Settings("m", "m"), SCORER)])
    plan = plan_of(wide)
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert plan.count("FileScan") == 1
    # Each of the three fields is cut into words once.
    assert optimized(wide).count("split(") == len(TEXT_COLS)


def test_a_filter_on_the_label_does_not_score_twice(spark, data):
    videos = views.videos(spark, data)
    passed = SCORER.label(videos, SCREEN, Settings("m", "m")).filter(F.col("label") == "TRUE")
    assert optimized(passed).count("split(") == len(TEXT_COLS)


def test_filters_on_other_columns_still_reach_the_scan(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").withColumnRenamed(
        "text", "description"
    )
    found = find_terms(documents, INSULTS).filter("lang = 'en'").select("doc_id", "_found_description")
    plan = plan_of(found)
    assert "EqualTo(lang,en)" in plan
    assert "source" not in plan.split("ReadSchema")[1]
