"""The results table: batches that appear whole or not at all, buckets, compaction, attempts."""

import pandas as pd
import pytest

from screenflow.operators.score import BatchScorer, requests
from screenflow.plans.screening import open_keys, prepare_rows, run_stage, run_two_pass
from screenflow.sources import results as store
from screenflow.sources.results import compact_results, read_attempts, read_commits, read_results, write_results
from screenflow.spec import CLASSIFY, SCREEN, Settings
from tests.conftest import plan_of
from workloads import views
from workloads.models import SCORER

ONE = Settings("m", "one")
ROW = "url string, label string, prob_true double, rationale string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "results")


def rows(spark, *urls, label="TRUE"):
    return spark.createDataFrame([(u, label, 0.5, None) for u in urls], ROW)


def urls(spark, path, stage="screen", model="one"):
    return sorted(r["url"] for r in read_results(spark, path, stage, model).collect())


def test_a_crash_between_files_and_commit_leaves_nothing(spark, path, monkeypatch):
    write_results(rows(spark, "a"), path, "screen", "one", "r", 0)

    def dies(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as patched:
        patched.setattr(store, "commit", dies)
        with pytest.raises(RuntimeError, match="lost driver"):
            write_results(rows(spark, "b", "c"), path, "screen", "one", "r", 1)
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data")
    assert files.count() == 3, "the files are there"
    assert urls(spark, path) == ["a"]
    assert sorted(r["url"] for r in read_results(spark, path).collect()) == ["a"]
    write_results(rows(spark, "b", "c"), path, "screen", "one", "r", 1)
    assert urls(spark, path) == ["a", "b", "c"]


def test_a_run_that_dies_is_resumed_as_if_it_had_not_begun(spark, data, tmp_path, monkeypatch):
    videos = views.videos(spark, data)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    run_two_pass(spark, videos, whole, ONE, SCORER)
    with monkeypatch.context() as patched:
        patched.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_stage(spark, videos, broken, SCREEN, ONE, SCORER, n_batches=3)
    run_two_pass(spark, videos, broken, ONE, SCORER, n_batches=2)
    for stage in (SCREEN, CLASSIFY):
        got = [
            sorted((r["url"], r["label"]) for r in read_results(spark, p, stage.name, "one").collect())
            for p in (whole, broken)
        ]
        assert got[0] == got[1]
    assert [r["batch_id"] for r in read_commits(spark, broken, "screen").orderBy("batch_id").collect()] == [0, 1]


def test_a_replay_may_hold_fewer_rows(spark, path):
    write_results(rows(spark, "a", "b"), path, "screen", "one", "r", 0)
    write_results(rows(spark, "b"), path, "screen", "one", "r", 0)
    assert urls(spark, path) == ["b"]
    write_results(rows(spark), path, "screen", "one", "r", 0)
    assert urls(spark, path) == []


@pytest.mark.parametrize("model", ["a/b c=d:e%f", "ü 'quoted' \"x\"", "{x}[y]"])
def test_model_labels_with_any_characters(spark, path, model):
    write_results(rows(spark, "a"), path, "screen", model, "r", 0)
    write_results(rows(spark, "b"), path, "screen", "other", "r", 0)
    assert urls(spark, path, model=model) == ["a"]
    assert {(r["url"], r["model_label"]) for r in read_results(spark, path).collect()} == {("a", model), ("b", "other")}
    assert [r["url"] for r in read_results(spark, path, model_label=model).collect()] == ["a"]


def test_compaction_keeps_what_is_visible_in_one_file_a_bucket(spark, path):
    for batch in range(4):
        write_results(rows(spark, *(f"u{batch}-{i}" for i in range(20))), path, "screen", "one", "r", batch)
    write_results(rows(spark, "u0-0", label="FALSE"), path, "screen", "one", "r", 0)
    write_results(rows(spark, "z", label=None), path, "screen", "one", "s", 0)
    write_results(rows(spark, "other"), path, "screen", "two", "r", 0)
    before = sorted(map(tuple, read_results(spark, path, "screen", "one").collect()))
    tries = read_attempts(spark, path).collect()
    compact_results(spark, path, "screen", "one", buckets=3)
    after = read_results(spark, path, "screen", "one")
    assert sorted(map(tuple, after.collect())) == before and len(before) == 61
    assert read_attempts(spark, path).collect() == tries and len(tries) == 1
    files = [f for f in after.inputFiles() if "/data/" in f]
    assert len(files) <= 3 and all("generation=1/buckets=3" in f for f in files)
    write_results(rows(spark, "new"), path, "screen", "one", "t", 0)
    assert urls(spark, path) == sorted([u for u, *_ in before] + ["new"])
    assert sorted(r["url"] for r in read_results(spark, path).collect()) == sorted([*urls(spark, path), "other"])
    compact_results(spark, path, "screen", "missing")


def test_resume_does_not_move_the_results(spark, data, path, conf):
    """Both joins of a resumed, gated run read the results by their buckets."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    videos = views.videos(spark, data)
    run_two_pass(spark, videos.filter("ord < 150"), path, ONE, SCORER)
    done = read_results(spark, path, "classify", "one").select("url")
    gate = read_results(spark, path, "screen", "one").filter("label = 'TRUE'")
    keys = open_keys(prepare_rows(videos, ONE), done, gate)
    plan = plan_of(keys)
    assert plan.count("Bucketed: true") == 2
    # The shuffles by url are those of the table's keys; attempts meet the commits on their own columns.
    moved = [line for line in plan.splitlines() if "hashpartitioning(url" in line]
    assert len(moved) == 1, plan
    whole = str(path) + "-whole"
    run_two_pass(spark, videos, path, ONE, SCORER)
    run_two_pass(spark, videos, whole, ONE, SCORER)
    for stage in ("screen", "classify"):
        assert urls(spark, path, stage) == urls(spark, whole, stage)


def failing(rule):
    def make(system_prompt):
        return lambda texts: pd.DataFrame(
            {"label": "TRUE", "error": [f"bad {t}" if rule(t) else None for t in texts]}
        )

    return BatchScorer(make)


def test_failed_rows_are_counted_and_tried_a_bounded_number_of_times(spark, path):
    texts = spark.createDataFrame([(f"u{i}", f"text {i}") for i in range(12)], "url string, description string")
    asked = Settings("m", "one", max_tries=2)
    odd = lambda t: int(t.split()[-1]) % 2 == 1
    never = lambda t: int(t.split()[-1]) % 4 == 1
    run_stage(spark, texts, path, SCREEN, asked, failing(odd))
    assert len(urls(spark, path)) == 6
    run_stage(spark, texts, path, SCREEN, asked, failing(never))
    assert len(urls(spark, path)) == 9
    tries = {(r["url"], r["try"], r["error"]) for r in read_attempts(spark, path, "screen", "one").collect()}
    assert {(u, n) for u, n, _ in tries} == {(f"u{i}", 1) for i in (1, 3, 5, 7, 9, 11)} | {(f"u{i}", 2) for i in (1, 5, 9)}
    assert ("u5", 2, "bad description: text 5") in tries
    # u1, u5 and u9 have failed twice: a third run leaves them alone, unless it may try more often.
    run_stage(spark, texts, path, SCREEN, asked, failing(lambda t: False))
    assert len(urls(spark, path)) == 9
    run_stage(spark, texts, path, SCREEN, ONE, failing(lambda t: False))
    assert len(urls(spark, path)) == 12


def test_commits_after_a_number_of_rows(spark, path):
    texts = spark.createDataFrame([(f"u{i}", f"text {i}") for i in range(100)], "url string, description string")
    run_stage(spark, texts, path, SCREEN, ONE, failing(lambda t: False), commit_rows=30)
    commits = read_commits(spark, path).collect()
    assert sorted(r["batch_id"] for r in commits) == [0, 1, 2, 3]
    assert sum(r["n_rows"] for r in commits) == 100


def test_rare_copies_do_not_move_other_texts(spark, path, conf):
    from screenflow.operators.resume import one_row_per_key

    videos = spark.createDataFrame([(f"u{i}", f"text {i}") for i in range(50)] + [("u7", "again")], "url string, description string")
    one = one_row_per_key(prepare_rows(videos, ONE))
    assert one.count() == 50 and one.select("url").distinct().count() == 50
    plain = one_row_per_key(prepare_rows(videos.filter("url != 'u7'"), ONE))
    assert "Exchange" not in plan_of(plain)


def test_requests_keep_to_the_token_budget():
    texts = pd.Series(["x" * n for n in (4, 8, 400, 4, 4, 4, 0)], index=[9, 8, 7, 6, 5, 4, 3])
    assert [list(p.index) for p in requests(texts, 3)] == [[9, 8], [7], [6, 5, 4, 3]]
    assert [list(p.index) for p in requests(texts, None)] == [list(texts.index)]
    assert [len(p) for p in requests(texts, 10**6)] == [7]


def test_budgeted_scoring_gives_every_row_its_own_label(spark):
    def make(system_prompt):
        return lambda texts: pd.DataFrame({"label": [t[-1] for t in texts], "rationale": [str(len(texts))] * len(texts)})

    videos = spark.createDataFrame([(f"u{i}", "x" * (40 * (i % 5)) + str(i % 3)) for i in range(200)], "url string, description string").coalesce(1)
    scored = BatchScorer(make, token_budget=60).label(videos, SCREEN, ONE, "").collect()
    assert {r["url"]: r["label"] for r in scored} == {f"u{i}": str(i % 3) for i in range(200)}
    assert max(int(r["rationale"]) for r in scored) < 10
