"""Rows whose texts changed, and what a run tells of itself while it goes on."""

import pytest
from pyspark.sql import functions as F

from screenflow.plans.screening import run_stage, run_two_pass
from screenflow.sources.progress import ARRIVED, read_progress
from screenflow.sources.results import compact_results, latest, read_results
from screenflow.spec import CLASSIFY, SCREEN, Settings
from screenflow.streaming.incremental import run_incremental
from tests.test_results import failing
from workloads.models import SCORER

ASKED = Settings("m", "one", rescore_changed=True)
VIDEO = "url string, description string, scrape_status string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "results")


def last(spark, path, stage="screen", as_of=None):
    rows = latest(read_results(spark, path, stage, "one"), as_of)
    return {r["url"]: (r["label"], r["run_id"]) for r in rows.collect()}


def test_a_changed_text_is_due_again_even_if_it_changes_back(spark, path):
    def run(run_id, *texts):
        rows = spark.createDataFrame([(f"u{i}", t, "ok") for i, t in enumerate(texts)], VIDEO)
        run_stage(spark, rows, path, SCREEN, ASKED, SCORER, run_id=run_id)

    run("a", "idiot", "x", None)
    between = read_results(spark, path).agg(F.max("scored_at")).first()[0]
    run("b", "fine", "x", None, "new")
    assert last(spark, path) == {"u0": ("FALSE", "b"), "u1": ("FALSE", "a"), "u2": ("FALSE", "a"), "u3": ("FALSE", "b")}
    assert last(spark, path, as_of=between) == {"u0": ("TRUE", "a"), "u1": ("FALSE", "a"), "u2": ("FALSE", "a")}
    run("c", "idiot", "x", "", "new")
    assert last(spark, path) == {"u0": ("TRUE", "c"), "u1": ("FALSE", "a"), "u2": ("FALSE", "c"), "u3": ("FALSE", "b")}
    compact_results(spark, path, "screen", "one")
    run("d", "idiot", "x", "", "new")
    assert "d" not in {run_id for _, run_id in last(spark, path).values()}


def test_results_stored_without_a_digest_count_as_current(spark, path):
    rows = spark.createDataFrame([("a", "idiot", "ok")], VIDEO)
    run_stage(spark, rows, path, SCREEN, Settings("m", "one"), SCORER, run_id="plain")
    run_stage(spark, rows.withColumn("description", F.lit("x")), path, SCREEN, ASKED, SCORER, run_id="asked")
    assert last(spark, path) == {"a": ("TRUE", "plain")}


def test_the_gate_follows_the_last_label(spark, path):
    def both(text):
        rows = spark.createDataFrame([("a", text, "ok")], VIDEO)
        run_two_pass(spark, rows, path, ASKED, SCORER)

    both("fine")
    assert last(spark, path, "classify") == {}
    both("idiot clown scum")
    assert last(spark, path, "classify")["a"][0] == "TRUE"
    n = read_results(spark, path, "classify", "one").count()
    both("fine")
    assert last(spark, path)["a"][0] == "FALSE" and read_results(spark, path, "classify", "one").count() == n


def test_tries_are_counted_for_each_text(spark, path):
    asked = Settings("m", "one", rescore_changed=True, max_tries=1)

    def run(text, fails):
        rows = spark.createDataFrame([("a", text, "ok")], VIDEO)
        run_stage(spark, rows, path, SCREEN, asked, failing(lambda t: fails))

    run("x 1", True)
    run("x 1", False)
    assert last(spark, path) == {}, "given up"
    run("x 2", False)
    assert last(spark, path)["a"][0] == "TRUE"


def test_progress_of_batches(spark, path, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(f"u{i}", f"text {i}", "ok") for i in range(90)], VIDEO)
    run_stage(spark, rows, path, SCREEN, Settings("m", "one"), failing(lambda t: t.endswith("7")), commit_rows=30, run_id="r", progress_path=log)
    got = read_progress(spark, log).orderBy("batch_id").collect()
    assert [r["batch_id"] for r in got] == [0, 1, 2] and {r["total"] for r in got} == {90}
    assert sum(r["n_rows"] for r in got) == 81 and sum(r["n_failed"] for r in got) == 9
    assert [r["done"] for r in got] == [sum(x["n_rows"] for x in got[: i + 1]) for i in range(3)]
    assert all(r["rows_per_sec"] > 0 and r["eta_sec"] >= 0 for r in got)


def test_progress_of_a_stream(spark, path, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for part in (["idiot clown scum", "x"], ["y"]):
        spark.createDataFrame([(t, t, "ok") for t in part], VIDEO).coalesce(1).write.mode("append").parquet(source)
    run_incremental(
        spark, source, VIDEO, path, str(tmp_path / "c"), [SCREEN, CLASSIFY], Settings("m", "one"), SCORER,
        run_id="s", max_files=1, progress_path=log,
    )
    got = {(r["stage"], r["batch_id"]): r["n_rows"] for r in read_progress(spark, log).collect()}
    assert got == {(ARRIVED, 0): 2, (ARRIVED, 1): 1, ("screen", 0): 2, ("screen", 1): 1, ("classify", 0): 1, ("classify", 1): 0}
