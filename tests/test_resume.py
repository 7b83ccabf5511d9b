import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from screenflow.operators import resume
from screenflow.operators.compare import long_results, wide_results
from screenflow.operators.lookup import hot_keys, join_lookup
from screenflow.operators.rows import content_key, pending_counts, row_filter
from screenflow.operators.score import SignalScorer
from screenflow.plans.sample import sample_run
from screenflow.plans.screening import labels_for_rows, run_stage, run_two_pass
from screenflow.sources.results import read_results, write_results
from screenflow.spec import CLASSIFY, SCREEN, Settings
from tests.conftest import plan_of
from workloads import views
from workloads.models import SCORER

ONE = Settings("m", "one")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "results")


def stored(spark, path, stage=SCREEN, settings=ONE):
    rows = read_results(spark, path, stage.name, settings.model_label)
    return sorted((r["url"], r["label"], r["prob_true"]) for r in rows.collect())


def test_reading_before_the_first_write(spark, path):
    assert read_results(spark, path, "screen", "one").isEmpty()


def test_two_runs_and_an_interrupted_run_equal_one(spark, data, tmp_path):
    videos = views.videos(spark, data)
    whole, split, broken = (str(tmp_path / n) for n in ("whole", "split", "broken"))
    run_stage(spark, videos, whole, SCREEN, ONE, SCORER)
    run_stage(spark, videos.filter("ord < 70"), split, SCREEN, ONE, SCORER)
    run_stage(spark, videos, split, SCREEN, ONE, SCORER, n_batches=3)
    # A run that died after its first batch: only that batch is there.
    run_stage(spark, videos, str(tmp_path / "full"), SCREEN, ONE, SCORER, n_batches=4)
    first = read_results(spark, str(tmp_path / "full")).filter("batch_id = 0")
    assert 0 < first.count() < videos.count()
    write_results(first, broken, SCREEN.name, ONE.model_label, "died", 0)
    run_stage(spark, videos, broken, SCREEN, ONE, SCORER, n_batches=2)
    assert stored(spark, whole) == stored(spark, split) == stored(spark, broken)
    assert len(stored(spark, whole)) == videos.count()


def test_nothing_pending_changes_nothing(spark, data, path):
    videos = views.videos(spark, data)
    run_stage(spark, videos, path, SCREEN, ONE, SCORER)
    before = stored(spark, path)
    run_stage(spark, videos, path, SCREEN, ONE, SCORER)
    assert stored(spark, path) == before


def test_a_run_id_is_used_once(spark, data, path):
    videos = views.videos(spark, data)
    run_stage(spark, videos, path, SCREEN, ONE, SCORER, run_id="r")
    with pytest.raises(ValueError, match="needs a new id"):
        run_stage(spark, videos, path, SCREEN, ONE, SCORER, run_id="r")


def test_a_replayed_batch_replaces_itself_only(spark, path):
    def rows(*urls):
        return spark.createDataFrame(
            [(u, "TRUE", 0.5, None) for u in urls],
            "url string, label string, prob_true double, rationale string",
        )

    write_results(rows("a", "b"), path, "screen", "one", "r", 0)
    write_results(rows("c"), path, "screen", "one", "r", 1)
    write_results(rows("a", "b"), path, "screen", "one", "r", 0)
    write_results(rows("z"), path, "screen", "two", "r", 0)
    assert [u for u, _, _ in stored(spark, path)] == ["a", "b", "c"]


def test_results_scan_reads_one_stage_and_model(spark, data, path):
    videos = views.videos(spark, data)
    run_two_pass(spark, videos, path, ONE, SCORER)
    results = read_results(spark, path, "screen", "one").select("url")
    assert "ReadSchema: struct<url:string,label:string,run_id:string,batch_id:bigint,attempt:string>" in plan_of(results)
    files = results.inputFiles()
    assert files and all("/stage=screen/model_label=one/" in f for f in files if "/commits/" not in f)


VIDEO = "url string, description string, scrape_status string, ord bigint"


def test_copies_of_a_key_are_scored_once_usable_rows_first(spark, path):
    rows = spark.createDataFrame(
        [("a", "idiot", "ok", 2), ("a", "fine", "ok", 1), ("b", "idiot", "error", 1), ("b", "idiot", "ok", 2)],
        VIDEO,
    )
    run_stage(spark, rows, path, SCREEN, ONE, SCORER, ord_col="ord")
    assert [(u, label) for u, label, _ in stored(spark, path)] == [("a", "FALSE"), ("b", "TRUE")]
    back = labels_for_rows(rows, read_results(spark, path), SCREEN, ONE)
    assert back.count() == 4


def test_copies_without_an_order_give_the_same_row_for_any_partitioning(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "idiot", "ok", 1), ("a", "fine", "ok", 1), ("a", "clown scum", "ok", 1)], VIDEO
    )
    got = []
    for n in (1, 2, 3):
        path = str(tmp_path / str(n))
        run_stage(spark, rows.repartition(n), path, SCREEN, ONE, SCORER)
        got.append(stored(spark, path))
    assert got[0] == got[1] == got[2] and len(got[0]) == 1


def test_null_key_raises(spark, path):
    rows = spark.createDataFrame([(None, "x", "ok", 1)], VIDEO)
    with pytest.raises(PySparkException, match="row without url"):
        run_stage(spark, rows, path, SCREEN, ONE, SCORER)


def test_gate_and_skips(spark, data, path):
    videos = views.videos(spark, data)
    run_two_pass(spark, videos, path, ONE, SCORER)
    first = {u: label for u, label, _ in stored(spark, path)}
    second = {u: label for u, label, _ in stored(spark, path, CLASSIFY)}
    assert set(second) == {u for u, label in first.items() if label in ("TRUE", "SKIPPED")}
    assert {u for u, x in first.items() if x == "SKIPPED"} == {
        u for u, x in second.items() if x == "SKIPPED"
    }


def test_a_failed_copy_does_not_open_the_gate_for_others(spark, path):
    rows = spark.createDataFrame(
        [("a", "idiot clown scum", "error", 2), ("a", "idiot clown scum", "ok", 1)], VIDEO
    )
    # No screen results: the good copy is behind the gate, so its key stays pending.
    run_stage(spark, rows, path, CLASSIFY, ONE, SCORER, ord_col="ord")
    assert stored(spark, path, CLASSIFY) == []
    run_two_pass(spark, rows, path, ONE, SCORER, ord_col="ord")
    assert [(u, x) for u, x, _ in stored(spark, path, CLASSIFY)] == [("a", "TRUE")]


@pytest.mark.parametrize("first", ["error", "ok"])
@pytest.mark.parametrize("order", [None, "ord"])
def test_equal_copies_give_the_usable_label_in_any_order(spark, path, first, order):
    second = "ok" if first == "error" else "error"
    rows = spark.createDataFrame([("a", "idiot", first, 1), ("a", "idiot", second, 1)], VIDEO)
    run_stage(spark, rows.coalesce(1), path, SCREEN, ONE, SCORER, ord_col=order)
    assert [(u, x) for u, x, _ in stored(spark, path)] == [("a", "TRUE")]


def test_a_filtered_good_copy_stays_pending(spark, path):
    rows = spark.createDataFrame([("a", "x", "error", 1), ("a", "idiot", "ok", 2)], VIDEO)
    run_stage(spark, rows, path, SCREEN, Settings("m", "one", row_filter="description=x"), SCORER)
    assert stored(spark, path) == []
    run_stage(spark, rows, path, SCREEN, ONE, SCORER)
    assert [(u, x) for u, x, _ in stored(spark, path)] == [("a", "TRUE")]


def test_content_keys_score_every_different_row(spark, path):
    rows = spark.createDataFrame(
        [("a", "idiot", "ok", 1), ("a", "x", "ok", 2), (None, "idiot", "ok", 3), ("a", "x", "error", 4), ("a", "x", "ok", 5)],
        VIDEO,
    )
    keyed = content_key(rows)
    run_stage(spark, keyed, path, SCREEN, ONE, SCORER)
    back = labels_for_rows(keyed, read_results(spark, path), SCREEN, ONE).orderBy("ord")
    labels = [r["is_mental_health_broad_one"] for r in back.collect()]
    assert labels == ["TRUE", "FALSE", "TRUE", "SKIPPED", "FALSE"]
    assert len(stored(spark, path)) == 4


def test_every_batch_has_many_files(spark, data, path):
    staged = resume.stage_batches(views.videos(spark, data), path, 8)
    assert staged.filter("batch_id = 3").select(F.input_file_name()).distinct().count() > 2


def test_failed_rows_are_skipped_before_gate_and_filter(spark, path):
    rows = spark.createDataFrame(
        [("a", "idiot clown scum", "error", 1), ("b", "idiot", "ok", 2), ("c", "x", None, 3)], VIDEO
    )
    only = Settings("m", "one", row_filter="url=b")
    run_stage(spark, rows, path, CLASSIFY, ONE, SCORER)  # no screen results yet
    assert [(u, x) for u, x, _ in stored(spark, path, CLASSIFY)] == [("a", "SKIPPED")]
    run_stage(spark, rows, path, SCREEN, only, SCORER)
    assert [(u, x) for u, x, _ in stored(spark, path)] == [("a", "SKIPPED"), ("b", "TRUE")]


def test_row_filter(spark):
    rows = spark.createDataFrame([("a=b", 1), ("c", 2), (None, 3)], "c string, n int")
    assert [r["n"] for r in row_filter(rows, "c=a=b").collect()] == [1]
    assert row_filter(rows, "n=1").isEmpty()
    assert row_filter(rows, None).count() == 3
    with pytest.raises(ValueError, match="no column 'x'"):
        row_filter(rows, "x=1")
    counts = pending_counts(rows.withColumn("label", F.lit(None).cast("string")), "label", "c=c")
    assert counts.first().asDict() == {"pending": 1, "done": 2, "total": 3}


def test_exact_batches_with_uneven_order_values(spark):
    rng = random.Random(3)
    # A third of the rows sits in a narrow range far from the others.
    values = rng.sample(range(10**9), 700) + list(range(10**12, 10**12 + 350))
    rows = spark.createDataFrame([(x,) for x in values], "ord bigint").repartition(5)
    got = resume.exact_batches(rows, "ord", 64, n_ranges=7)
    assert {r["ord"]: r["batch_id"] for r in got.collect()} == {
        x: i // 64 for i, x in enumerate(sorted(values))
    }


def test_exact_batches_of_few_rows(spark):
    rows = spark.range(3).withColumnRenamed("id", "ord")
    got = resume.exact_batches(rows, "ord", 2, n_ranges=50).collect()
    assert sorted((r["ord"], r["batch_id"]) for r in got) == [(0, 0), (1, 0), (2, 1)]
    assert resume.exact_batches(rows.limit(0), "ord", 2).count() == 0


HOT = "case when id % 3 = 0 then 'hot' else cast(id as string) end as url"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_hot_key_is_spread_over_tasks(spark, conf, how):
    """A third of the rows share one key; some keys are missing from the lookup."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    rows = spark.range(0, 60_000, 1, 12).selectExpr(HOT, "id")
    lookup = (
        rows.select("url").distinct().filter("url = 'hot' or url not like '%7'")
        .withColumn("label", F.lit("TRUE"))
    )
    assert hot_keys(rows) == ["hot"]
    joined = join_lookup(rows, lookup, how)
    plain = rows.join(lookup, "url", how)
    assert joined.columns == plain.columns
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain.columns]
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64(*key).cast("decimal(38,0)"))]
    assert joined.agg(*digest).first() == plain.agg(*digest).first()
    if how != "left_anti":
        places = joined.groupBy(F.spark_partition_id(), "url").count().filter("url = 'hot'").collect()
        assert sum(r["count"] for r in places) == 20_000
        assert max(r["count"] for r in places) < 10_000


@pytest.mark.parametrize("threshold", ["-1", "10m"], ids=["many keys", "few keys"])
@pytest.mark.parametrize("n_batches", [1, 2])
def test_hot_key_runs(spark, tmp_path, conf, threshold, n_batches):
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    videos = spark.range(0, 6000, 1, 6).selectExpr(
        HOT, "id as ord", "case when id % 4 = 0 then 'idiot clown scum' else 'x' end as description"
    )
    path = str(tmp_path / "r")
    options = {"ord_col": "ord", "n_batches": n_batches}
    run_two_pass(spark, videos.filter("ord < 3000"), path, ONE, SCORER, **options)
    run_two_pass(spark, videos, path, ONE, SCORER, **options)
    expected = {"hot": "TRUE"} | {
        str(i): "FALSE" if i % 4 else "TRUE" for i in range(6000) if i % 3
    }
    assert {u: x for u, x, _ in stored(spark, path)} == expected
    assert {u for u, x, _ in stored(spark, path, CLASSIFY)} == {
        u for u, x in expected.items() if x == "TRUE"
    }
    back = labels_for_rows(videos, read_results(spark, path), SCREEN, ONE)
    assert back.filter(F.col("url") == "hot").count() == 2000 and back.count() == 6000


def test_no_key_is_hot_in_an_even_table(spark):
    assert hot_keys(spark.range(1000).selectExpr("cast(id as string) as url")) == []
    assert hot_keys(spark.range(0).selectExpr("cast(id as string) as url")) == []


def test_wide_and_long_results_are_inverse(spark, data, path):
    two = Settings("n", "two", rationale=True)
    videos = views.videos(spark, data)
    run_two_pass(spark, videos, path, ONE, SCORER)
    run_two_pass(spark, videos, path, two, SignalScorer(SCORER.lexicon, 1.0, 2.0))
    results, models, stages = read_results(spark, path), [ONE, two], [SCREEN, CLASSIFY]
    again = long_results(wide_results(results, models, stages), models, stages)
    key = ["url", "stage", "model_label", "label"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(
        map(tuple, results.select(key).collect())
    )


def test_sample_run_lists_both_stages(spark, data, tmp_path):
    listing = sample_run(
        spark, views.videos(spark, data), 20, "ord", str(tmp_path / "slice"),
        str(tmp_path / "results"), Settings("m", "one", rationale=True), SCORER,
    )
    assert listing.columns == [
        "url", "is_mental_health_broad_one", "is_mental_health_one", "is_mental_health_one_rationale"
    ]
    assert listing.count() == 20


def test_pending_rows_move_keys_only(spark, data):
    videos = views.videos(spark, data)
    done = videos.select("url").limit(150)
    pending = resume.pending_rows(videos, done)
    assert pending.count() == videos.count() - 150
    plan = plan_of(pending)
    assert "LeftSemi" in plan and "Exchange hashpartitioning" not in plan, "few keys are broadcast to the texts"


def test_progress(spark):
    rows = spark.createDataFrame(
        [("screen", "m", "r", b, f"2026-01-01 00:00:{s}") for b, s in ((0, 10), (0, 10), (1, 20), (2, 40))],
        "stage string, model_label string, run_id string, batch_id bigint, t string",
    ).withColumn("scored_at", F.col("t").cast("timestamp"))
    got = resume.batch_progress(rows, 8).orderBy("batch_id").collect()
    assert [r["done"] for r in got] == [2, 3, 4]
    assert [r["percent"] for r in got] == [25.0, 37.5, 50.0]
    assert got[0]["rows_per_sec"] is None
    assert got[2]["rows_per_sec"] == pytest.approx(4 / 30) and got[2]["eta_sec"] == pytest.approx(30)
