"""Model labels and columns whose names hold dots and backticks."""

import pytest

from screenflow import CLASSIFY, SCREEN, Settings, SignalScorer, evaluate_stage, read_truth_csv
from screenflow.functions.strings import row_text
from screenflow.operators.compare import long_results, model_agreement
from screenflow.operators.rows import pending_counts, skip_failed
from screenflow.sources.benchmark import select_tasks
from screenflow.sources.metadata import result_listing


def test_model_label_with_a_dot(spark):
    settings = Settings(model="m", model_label="m-2.5")
    name = settings.output_name(CLASSIFY)
    assert "." in name
    wide = spark.createDataFrame([("a", "TRUE", "ok"), ("b", None, "error")], f"url string, `{name}` string, scrape_status string")
    assert result_listing(wide, settings, SCREEN, CLASSIFY).columns == ["url", name]
    assert [r[name] for r in skip_failed(wide, name).orderBy("url").collect()] == ["TRUE", "SKIPPED"]
    assert pending_counts(wide, name).first()["pending"] == 1
    assert [r["n_true"] for r in model_agreement(wide, [settings], CLASSIFY).orderBy("url").collect()] == [1, 0]
    assert [r["label"] for r in long_results(wide, [settings], [CLASSIFY]).collect()] == ["TRUE"]


def test_text_column_with_a_backtick(spark):
    df = spark.createDataFrame([("x",)], "`a.``b` string")
    assert df.select(row_text(df.columns, ["a.`b"]).alias("t")).first()["t"] == "a.`b: x"


def test_csv_header_with_a_dot(spark, tmp_path):
    (tmp_path / "t.csv").write_text("url,note.1\na,b\n")
    assert read_truth_csv(spark, str(tmp_path / "t.csv")).first()["note.1"] == "b"


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="use"):
        evaluate_stage(spark, spark.createDataFrame([("a", "TRUE")], f"url string, {CLASSIFY.truth_col} string"), CLASSIFY, Settings(model="m", model_label="m"), SignalScorer())
    with pytest.raises(ValueError, match="reply column"):
        select_tasks(spark.createDataFrame([("DR", 1, "q")], "task string, idx int, query string"))
