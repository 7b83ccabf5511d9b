import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from screenflow.operators.score import BatchScorer
from screenflow.plans.screening import run_stage
from screenflow.sources.results import read_results
from screenflow.spec import SCREEN, Settings

ROWS = [(f"u{i}", f"text {i}", "ok") for i in range(30)]
SCHEMA = "url string, description string, scrape_status string"
PLAIN = Settings("m", "m", context_limit=4096)


def replying(reply):
    """A scorer that answers every text with ``reply(text)``."""

    def make(system_prompt):
        return lambda texts: pd.DataFrame({"reply": [reply(t) for t in texts]})

    return make


def labels(spark, path):
    return {r["url"]: r for r in read_results(spark, path, "screen", "m").collect()}


def test_raw_replies_are_parsed(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    asked = Settings("m", "m", rationale=True)
    reply = '{"label": "TRUE", "rationale": " since "}'
    scorer = BatchScorer(replying(lambda t: reply if t.endswith("1") else "FALSE\nno"), 3)
    run_stage(spark, rows, str(tmp_path / "r"), SCREEN, asked, scorer)
    got = labels(spark, str(tmp_path / "r"))
    assert (got["u1"]["label"], got["u1"]["rationale"]) == ("TRUE", "since")
    assert (got["u2"]["label"], got["u2"]["rationale"]) == ("FALSE", "no")
    assert len(got) == 30


def test_failed_calls_are_not_stored_and_are_retried(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame(ROWS, SCHEMA)

    def flaky(system_prompt):
        def score(texts):
            odd = texts.str.endswith(("1", "3", "5", "7", "9"))
            return pd.DataFrame({"label": "TRUE", "error": odd.map(lambda x: "timeout" if x else None)})

        return score

    run_stage(spark, rows, path, SCREEN, PLAIN, BatchScorer(flaky))
    assert len(labels(spark, path)) == 15
    run_stage(spark, rows, path, SCREEN, PLAIN, BatchScorer(replying(lambda t: "FALSE")), n_batches=2)
    got = labels(spark, path)
    assert len(got) == 30
    assert sum(r["label"] == "TRUE" for r in got.values()) == 15


def test_a_raising_scorer_fails_the_run(spark, tmp_path):
    def broken(system_prompt):
        def score(texts):
            raise RuntimeError("server is gone")

        return score

    with pytest.raises(PySparkException, match="server is gone"):
        run_stage(
            spark, spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "r"), SCREEN, PLAIN, BatchScorer(broken)
        )


def test_routed_rows_never_reach_the_scorer(spark, tmp_path):
    rows = spark.createDataFrame(
        [("long", "x" * 20_000, "ok"), ("failed", "x", "error"), ("blank", " ", None), ("ok", "x", None)],
        SCHEMA,
    )

    def strict(system_prompt):
        def score(texts):
            assert texts.notna().all() and texts.str.len().max() < 100
            return pd.DataFrame({"label": ["TRUE"] * len(texts), "prob_true": [0.75] * len(texts)})

        return score

    run_stage(spark, rows, str(tmp_path / "r"), SCREEN, PLAIN, BatchScorer(strict), system_prompt="s")
    got = {u: (r["label"], r["prob_true"]) for u, r in labels(spark, str(tmp_path / "r")).items()}
    assert got == {
        "long": ("TOO_LONG", None), "failed": ("SKIPPED", None),
        "blank": ("TRUE", 0.75), "ok": ("TRUE", 0.75),
    }


def test_the_system_prompt_counts_towards_the_limit(spark):
    rows = spark.createDataFrame([("u", "x")], "url string, description string")
    scorer = BatchScorer(replying(lambda t: "TRUE"))
    short = scorer.label(rows, SCREEN, PLAIN, "s" * 16_000).first()
    long = scorer.label(rows, SCREEN, PLAIN, "s" * 17_000).first()
    assert (short["label"], long["label"]) == ("TRUE", "TOO_LONG")


def test_one_client_per_partition(spark):
    def make(system_prompt):
        import uuid

        client = uuid.uuid4().hex
        return lambda texts: pd.DataFrame({"label": "TRUE", "rationale": [client] * len(texts)})

    rows = spark.range(1000).selectExpr("concat('u', id) as url", "'t' as description")
    scored = BatchScorer(make, partitions=4).label(rows, SCREEN, PLAIN, "")
    assert scored.select(F.count_distinct("rationale")).first()[0] <= 4


def test_partitioning_does_not_change_results(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = []
    for n in (1, 5, None):
        scorer = BatchScorer(replying(lambda t: "TRUE" if int(t.split()[-1]) % 3 else "no label"), n)
        scored = scorer.label(rows.repartition(n or 2), SCREEN, PLAIN, "")
        got.append(sorted((r["url"], r["label"]) for r in scored.collect()))
    assert got[0] == got[1] == got[2]
