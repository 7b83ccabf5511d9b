import pytest
from pyspark.sql import functions as F

from screenflow.operators import evaluate as ev
from screenflow.operators.score import BatchScorer, SignalScorer
from screenflow.plans.conversion import convert_benchmark
from screenflow.plans.evaluation import evaluate_stage
from screenflow.sources.runlog import append_run, read_runs
from screenflow.sources.truth import read_truth_csv
from screenflow.spec import CLASSIFY, SCREEN, Settings
from tests.conftest import plan_of
from workloads import views
from workloads.models import INSULTS

# Counts and rounded metrics of logged evaluation runs, as
# (tp, tn, fp, fn, accuracy, precision, recall).
LOGGED = [
    (48, 0, 40, 0, 0.545, 0.545, 1.000),
    (34, 30, 10, 14, 0.727, 0.773, 0.708),
    (42, 28, 9, 10, 0.787, 0.824, 0.808),
    (40, 28, 9, 12, 0.764, 0.816, 0.769),
    (42, 30, 4, 13, 0.809, 0.913, 0.764),
    (48, 28, 6, 7, 0.854, 0.889, 0.873),
    (48, 30, 7, 4, 0.876, 0.873, 0.923),
    (47, 32, 5, 5, 0.888, 0.904, 0.904),
    (15, 54, 6, 14, 0.775, 0.714, 0.517),
    (19, 18, 5, 10, 0.712, 0.792, 0.655),
    (29, 17, 6, 0, 0.885, 0.829, 1.000),
    (30, 19, 1, 2, 0.942, 0.968, 0.938),
    (32, 19, 1, 0, 0.981, 0.970, 1.000),
    (26, 19, 0, 7, 0.865, 1.000, 0.788),
    (28, 19, 0, 5, 0.904, 1.000, 0.848),
    (33, 11, 8, 0, 0.846, 0.805, 1.000),
    (30, 19, 0, 3, 0.942, 1.000, 0.909),
]
ONE = Settings("m", "one", rationale=True)


def test_metrics_of_logged_runs(spark):
    rows = spark.createDataFrame(
        [(tp, tn, fp, fn, tp + tn + fp + fn, i) for i, (tp, tn, fp, fn, *_) in enumerate(LOGGED)],
        "tp bigint, tn bigint, fp bigint, fn bigint, total bigint, i int",
    )
    for r in ev.with_metrics(rows).collect():
        got = tuple(f"{r[c]:.3f}" for c in ("accuracy", "precision", "recall"))
        assert got == tuple(f"{x:.3f}" for x in LOGGED[r["i"]][4:])


def predictions(spark, rows):
    return spark.createDataFrame(rows, "url string, label string, rationale string")


def lookup(spark, rows):
    return spark.createDataFrame(rows, "url string, ground_truth string")


def test_counts_keep_multiplicity_and_leave_others_out(spark):
    pred = predictions(
        spark,
        [("a", "TRUE", "r")] * 3
        + [("b", "FALSE", None), ("c", "UNKNOWN", None), ("d", None, None), ("a", "FALSE", "x")]
        + [("e", "TOO_LONG", None), ("absent", "TRUE", None)],
    )
    truth = lookup(spark, [(u, "TRUE" if u == "a" else "FALSE") for u in "abcde"])
    counts = ev.confusion_counts(pred, truth)
    assert counts.first().asDict() == {
        "tp": 3, "tn": 1, "fp": 0, "fn": 1, "total": 5, "left_out": 3
    }
    matrix = {r["predicted"]: (r["FALSE"], r["TRUE"]) for r in ev.confusion_matrix(counts).collect()}
    assert matrix == {"FALSE": (1, 1), "TRUE": (0, 3)}
    detail = ev.evaluation_detail(pred, truth)
    assert detail.count() == 5
    assert [tuple(r) for r in ev.mismatches(detail).collect()] == [("a", "FALSE", "TRUE", "x")]


def test_predictions_are_counted_without_a_shuffle(spark):
    pred = spark.range(1000).selectExpr("cast(id as string) as url", "'TRUE' as label")
    truth = lookup(spark, [("1", "TRUE"), ("2", "FALSE")])
    plan = plan_of(ev.confusion_counts(pred, truth))
    below = plan.split("BroadcastHashJoin", 1)[1]
    assert "hashpartitioning" not in below and "SortMergeJoin" not in plan


def test_zero_denominators_are_null(spark):
    counts = ev.confusion_counts(
        predictions(spark, [("a", "FALSE", None)]), lookup(spark, [("a", "FALSE")])
    )
    r = ev.with_metrics(counts).first()
    assert r["accuracy"] == 1.0 and r["precision"] is None and r["recall"] is None
    nothing = ev.confusion_counts(
        predictions(spark, [("a", "UNKNOWN", None)]), lookup(spark, [("a", "FALSE")])
    )
    assert ev.with_metrics(nothing).first()["accuracy"] is None
    assert ev.confusion_matrix(nothing).isEmpty()


def test_the_last_truth_of_a_key_wins(spark):
    rows = spark.createDataFrame(
        [("a", "TRUE", 1), ("a", "FALSE", 3), ("a", "TRUE", 2)], "url string, t string, ord bigint"
    ).repartition(3)
    assert ev.truth_lookup(rows, "t").first()["ground_truth"] == "FALSE"


def test_a_hot_key_is_one_row_at_the_join(spark):
    pred = spark.range(0, 9000, 1, 6).selectExpr(
        "case when id % 3 = 0 then 'hot' else cast(id as string) end as url",
        "case when id % 2 = 0 then 'TRUE' else 'FALSE' end as label",
    )
    truth = pred.select("url").distinct().withColumn("ground_truth", F.lit("TRUE"))
    r = ev.confusion_counts(pred, truth).first()
    assert (r["tp"], r["fn"], r["total"]) == (4500, 4500, 9000)
    assert ev.evaluation_detail(pred, truth).count() == 9000


def test_evaluation_end_to_end(spark, data, tmp_path):
    truth = views.truth_rows(spark, data).withColumn(
        "rationale", F.when(F.col("rationale") != "n/a", F.col("rationale"))
    )
    scorer = SignalScorer(INSULTS, 1.0, 3.0)
    log, detail = str(tmp_path / "log"), str(tmp_path / "detail")
    for stage in (SCREEN, CLASSIFY):
        result = evaluate_stage(
            spark, truth, stage, ONE, scorer, use_examples=True,
            detail_path=f"{detail}_{stage.name}", log_path=log,
        )
    counts = result.counts.first()
    held_out = truth.filter("trim(lower(use)) = 'test'").count()
    assert counts["total"] + counts["left_out"] == held_out
    assert result.detail.count() == counts["total"]
    assert result.mismatches.count() == counts["fp"] + counts["fn"]
    saved = read_truth_csv(spark, f"{detail}_classify")
    assert saved.columns == ["url", "predicted", "ground_truth", "rationale", "ord"]
    assert saved.count() == counts["total"]
    runs = {r["stage"]: r for r in read_runs(spark, log).collect()}
    assert set(runs) == {"screen", "classify"}
    assert runs["classify"]["n_examples"] == truth.count() - held_out
    assert len(runs["classify"]["prompt_hash"]) == 8
    assert runs["screen"]["rows_per_sec"] > 0


def test_evaluation_scores_each_row_once(spark, data, tmp_path):
    """The reports share stored predictions: one scorer call per text."""
    import pandas as pd

    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def make(system_prompt):
        def score(texts):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(texts)))
            return pd.DataFrame({"label": ["TRUE"] * len(texts)})

        return score

    truth = views.truth_rows(spark, data)
    result = evaluate_stage(spark, truth, SCREEN, Settings("m", "m"), BatchScorer(make))
    for report in (result.metrics, result.matrix, result.detail, result.mismatches):
        report.collect()
    scored = sum(int(f.read_text()) for f in calls.iterdir())
    counts = result.counts.first()
    assert scored <= counts["total"] + counts["left_out"]
    assert "rationale" not in result.detail.columns


def test_evaluation_errors(spark, tmp_path):
    schema = f"url string, {CLASSIFY.truth_col} string, use string, ord bigint, description string"
    only_train = spark.createDataFrame([("a", "TRUE", "train", 1, "x")], schema)
    with pytest.raises(ValueError, match="no rows with use=test"):
        evaluate_stage(spark, only_train, CLASSIFY, ONE, SignalScorer())
    failed = spark.createDataFrame([("a", "TRUE", "test", 1, "x")], schema).withColumn(
        "scrape_status", F.lit("error")
    )
    log = tmp_path / "log"
    with pytest.warns(UserWarning, match="no row got a label"):
        report = evaluate_stage(spark, failed, CLASSIFY, ONE, SignalScorer(), log_path=str(log))
    assert report.counts.first()["left_out"] == 1 and not log.exists()


def test_evaluation_can_be_narrowed_by_another_truth_column(spark, data):
    truth = views.truth_rows(spark, data)
    narrow = Settings("m", "m", row_filter=f"{SCREEN.truth_col}=TRUE")
    result = evaluate_stage(spark, truth, CLASSIFY, narrow, SignalScorer(INSULTS, 1.0, 3.0))
    wanted = truth.filter(f"trim(lower(use)) = 'test' and {SCREEN.truth_col} = 'TRUE'").count()
    counts = result.counts.first()
    assert counts["total"] + counts["left_out"] == wanted


def test_the_log_is_appended_to(spark, tmp_path):
    path = str(tmp_path / "log")
    counts = spark.createDataFrame(
        [(1, 2, 3, 4, 10, 0)], "tp bigint, tn bigint, fp bigint, fn bigint, total bigint, left_out bigint"
    )
    for elapsed in (2.0, 0.0):
        append_run(ev.run_row(counts, SCREEN, ONE, 0, elapsed), path)
    rates = sorted((r["rows_per_sec"] for r in read_runs(spark, path).collect()), key=str)
    assert rates == [5.0, None]


def test_best_runs(spark):
    log = spark.createDataFrame(
        [("s", "m", 0.5, 0.9, "a"), ("s", "m", 0.7, 0.1, "b"), ("s", "m", 0.7, 0.2, "c"), ("s", "n", 0.1, None, "d")],
        "stage string, model string, accuracy double, recall double, prompt_hash string",
    )
    best = {r["model"]: r for r in ev.best_runs(log).collect()}
    assert (best["m"]["best_prompt"], best["m"]["n_runs"]) == ("c", 3)
    assert best["n"]["best_accuracy"] == 0.1


def test_a_converted_benchmark_can_be_evaluated(spark, tmp_path):
    records = [
        ("DR", i, f'Consider this post: "post {i} {w}" Question: x', f"{r}. Reasoning: r")
        for i, (w, r) in enumerate([("depression", "Yes"), ("cake", "No"), ("cake", "Yes"), ("adhd, ptsd", "Yes")])
    ]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(records, "task string, idx bigint, query string, response string").write.parquet(source)
    convert_benchmark(spark, source, target)
    report = evaluate_stage(
        spark, read_truth_csv(spark, target), CLASSIFY, ONE, SignalScorer(classify_threshold=1.0),
        system_prompt="prompt", log_path=str(tmp_path / "log"),
    )
    got = report.metrics.first()
    assert (got["tp"], got["tn"], got["fp"], got["fn"]) == (2, 1, 0, 1)
    run = read_runs(spark, str(tmp_path / "log")).first()
    assert run["assembled_hash"] and run["assembled_hash"] != run["prompt_hash"]
