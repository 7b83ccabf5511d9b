import hashlib

import pytest
from pyspark.sql import functions as F

from screenflow.functions.posts import extract_label, extract_post, extract_reasoning
from screenflow.operators.convert import convert_records, label_balance
from screenflow.plans.conversion import convert_benchmark
from screenflow.sources.benchmark import EVALUATION_COLS
from screenflow.sources.truth import read_truth_csv

POSTS = [
    ('Consider this post: "I feel low" Question: Does the poster suffer?', "I feel low"),
    ("Consider this post: 'a \"quoted\" word' Question: x", 'a "quoted" word'),
    ('Consider this post:\n"two\nlines "\n Question: x', "two\nlines"),
    ('Consider this post: "ends here"  \n', "ends here"),
    ("Consider this post: plain text  Question: x", "plain text"),
    ("Consider this post: no question", "Consider this post: no question"),
    ('say "x". Consider this post: "first" and "second" Question: q', 'first" and "second'),
    ("  bare text\u3000", "bare text"),
    ("", ""),
]
RESPONSES = [
    ("Yes, the poster does. Reasoning: it says so\nclearly ", "TRUE", "it says so\nclearly"),
    (" yes", "TRUE", ""),
    ("No. reasoning:none", "FALSE", "none"),
    ("Not sure. Reasoning: x", "FALSE", "x"),
    ("Reasoning: yes", None, ""),
    ("Unclear", None, ""),
    ("Yes. Reasoning: a Reasoning: b", "TRUE", "a Reasoning: b"),
    ("Yes. Reasoning:   ", "TRUE", ""),
    ("", None, ""),
]


def test_extract_post(spark):
    rows = spark.createDataFrame(POSTS, "q string, want string")
    for r in rows.select("q", "want", extract_post(F.col("q")).alias("got")).collect():
        assert r["got"] == r["want"], r["q"]


def test_extract_label_and_reasoning(spark):
    rows = spark.createDataFrame(RESPONSES, "r string, label string, reason string")
    got = rows.select(
        "*", extract_label(F.col("r")).alias("l"), extract_reasoning(F.col("r")).alias("x")
    )
    for r in got.collect():
        assert (r["l"], r["x"]) == (r["label"], r["reason"]), r["r"]


def test_extract_post_copes_with_a_long_post(spark):
    post = "word\n" * 40_000
    rows = spark.createDataFrame([(f'Consider this post: "{post}" Question: x',)], "q string")
    assert rows.select(extract_post(F.col("q"))).first()[0] == post.strip()


RECORDS = [
    ("DR", 0, 'Consider this post: "p0" Question: x', "Yes. Reasoning: r0"),
    ("DR", 1, 'Consider this post: "p1" Question: x', "unclear"),
    ("DR", 2, 'Consider this post: "p,2 ""q""\nnext" Question: x', "No."),
    ("CLP", 0, "bare", "no"),
]
RECORD_SCHEMA = "task string, idx bigint, query string, response string"


def test_cap_counts_source_rows_before_unlabelled_ones_are_dropped(spark):
    rows = spark.createDataFrame(RECORDS, RECORD_SCHEMA)
    assert [r["description"] for r in convert_records(rows, 2).filter("task = 'DR'").collect()] == ["p0"]
    assert convert_records(rows, 0).count() == convert_records(rows).count() == 3


def test_benchmark_file_round_trip(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(RECORDS, RECORD_SCHEMA).withColumnRenamed(
        "response", "gpt-3.5-turbo"
    ).write.partitionBy("task").parquet(source)
    balance = {r["task"]: r.asDict() for r in convert_benchmark(spark, source, target).collect()}
    assert balance["ALL"]["n_rows"] == 3 and balance["ALL"]["n_true"] == 1
    assert balance["CLP"]["share_true"] == 0.0
    loaded = read_truth_csv(spark, target)
    assert loaded.columns == [*EVALUATION_COLS, "ord"]
    rows = {r["url"]: r for r in loaded.collect()}
    key = "imhi:DR:0:" + hashlib.md5(b"p0").hexdigest()[:8]
    assert rows[key]["rationale"] == "r0" and rows[key]["use"] == "test"
    assert rows[key]["transcript"] is None
    assert 'p,2 ""q""\nnext' in {r["description"] for r in rows.values()}


def test_conversion_errors(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(RECORDS[1:2], RECORD_SCHEMA).write.parquet(source)
    with pytest.raises(ValueError, match="no labelled"):
        convert_benchmark(spark, source, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="unknown tasks"):
        convert_benchmark(spark, source, str(tmp_path / "out"), tasks=["other"])


def test_balance_adds_up(spark):
    rows = label_balance(convert_records(spark.createDataFrame(RECORDS, RECORD_SCHEMA))).collect()
    assert sum(r["n_rows"] for r in rows if r["task"] != "ALL") == 3
