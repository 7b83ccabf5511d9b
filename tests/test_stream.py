import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from screenflow.operators.score import BatchScorer
from screenflow.sources.results import read_results
from screenflow.spec import CLASSIFY, SCREEN, Settings
from screenflow.streaming.incremental import run_incremental
from workloads.models import INSULT_WORDS, SCORER, word_scorer
from workloads.queries import in_thirds, stream_progress

ONE = Settings("m", "one")
SCHEMA = "url string, description string, scrape_status string, ord bigint"


def drop_file(spark, folder, name, rows):
    """Write one parquet file under its own name, as a producer would."""
    staging = folder.parent / f"staging-{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(staging))
    folder.mkdir(exist_ok=True)
    shutil.copy(next(staging.glob("part-*.parquet")), folder / f"{name}.parquet")


def results(spark, path, stage=SCREEN):
    return {r["url"]: r["label"] for r in read_results(spark, str(path), stage.name, "one").collect()}


def test_only_new_rows_of_new_files_are_scored(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"

    def run(stage=SCREEN, scorer=SCORER):
        run_incremental(
            spark, str(inbox), SCHEMA, str(out), str(tmp_path / f"cp-{stage.name}"), stage, ONE, scorer,
            run_id=f"stream-{stage.name}", ord_col="ord", max_files=1,
        )

    drop_file(spark, inbox, "a", [("u1", "idiot clown scum", "ok", 1), ("u2", "x", "error", 2)])
    drop_file(spark, inbox, "b", [("u3", "nice", None, 3), ("u1", "other text", "ok", 4)])
    run()
    assert results(spark, out) == {"u1": "TRUE", "u2": "SKIPPED", "u3": "FALSE"}
    assert read_results(spark, str(out)).count() == 3
    assert read_results(spark, str(out)).select("batch_id").distinct().count() == 2
    before = read_results(spark, str(out)).agg(F.max("scored_at")).first()[0]
    run()
    assert read_results(spark, str(out)).agg(F.max("scored_at")).first()[0] == before
    drop_file(spark, inbox, "c", [("u3", "idiot", "ok", 5), ("u4", "idiot", "ok", 6)])
    run()
    assert results(spark, out) == {"u1": "TRUE", "u2": "SKIPPED", "u3": "FALSE", "u4": "TRUE"}
    run(CLASSIFY, BatchScorer(word_scorer(INSULT_WORDS)))
    assert results(spark, out, CLASSIFY) == {"u1": "TRUE", "u2": "SKIPPED", "u4": "TRUE"}


def test_a_replayed_epoch_gives_the_same_table(spark, tmp_path):
    """Losing the checkpoint replays epoch 0 into its own partition."""
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    drop_file(spark, inbox, "a", [("u1", "idiot", "ok", 1), ("u2", "x", "ok", 2)])
    for checkpoint in ("first", "second"):
        run_incremental(
            spark, str(inbox), SCHEMA, str(out), str(tmp_path / checkpoint), SCREEN, ONE, SCORER,
            run_id="stream", ord_col="ord",
        )
    assert read_results(spark, str(out)).count() == 2
    assert results(spark, out) == {"u1": "TRUE", "u2": "FALSE"}


def test_both_stages_in_one_stream(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"

    def run(stages, name):
        run_incremental(
            spark, str(inbox), SCHEMA, str(out), str(tmp_path / f"cp-{name}"), stages, ONE, SCORER,
            run_id=name, ord_col="ord", max_files=1,
        )

    drop_file(spark, inbox, "a", [("u1", "idiot clown scum", "ok", 1), ("u2", "x", "error", 2)])
    # Alone, the second stage must not drain a file that the first has not seen.
    with pytest.raises(StreamingQueryException, match="has not looked at"):
        run(CLASSIFY, "early")
    run([SCREEN, CLASSIFY], "both")
    drop_file(spark, inbox, "b", [("u3", "idiot", "ok", 3), ("u4", "nice", "ok", 4)])
    run([SCREEN, CLASSIFY], "both")
    run(CLASSIFY, "early")
    assert results(spark, out) == {"u1": "TRUE", "u2": "SKIPPED", "u3": "TRUE", "u4": "FALSE"}
    assert results(spark, out, CLASSIFY) == {"u1": "TRUE", "u2": "SKIPPED", "u3": "FALSE"}


def test_a_third_arrives_in_a_file_of_each_task_and_is_one_epoch(spark, tmp_path):
    rows = spark.range(240).selectExpr("id as doc_id", "'idiot clown scum' as text", "'en' as lang", "'web' as source", "cast(16 as bigint) as n_chars")
    rows = rows.unionByName(rows.limit(9)).withColumn("doc_id", F.when(F.col("doc_id") != 239, F.col("doc_id")))
    folder, source = tmp_path / "tables", tmp_path / "arriving"
    rows.repartition(4).write.parquet(str(folder / "documents.parquet"))
    documents = spark.read.parquet(str(folder / "documents.parquet"))
    files, tasks = [], documents.rdd.getNumPartitions()
    for _ in in_thirds(documents, str(source)):
        files.append(len(list(source.glob("part-*.parquet"))))
    assert tasks > 1 and files == [tasks, 2 * tasks, 3 * tasks]
    got = {(r["stage"], r["epoch"]): r["n_rows"] for r in stream_progress(spark, str(folder)).collect()}
    assert {k: n for k, n in got.items() if k[0] == "arrived"} == {("arrived", 0): 83, ("arrived", 1): 83, ("arrived", 2): 82}
    assert [got["screen", k] for k in range(3)] == [80, 80, 79]
