"""Benchmark records to the evaluation layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.functions.posts import (
    extract_label,
    extract_post,
    extract_reasoning,
    source_key,
)
from screenflow.sources.benchmark import EVALUATION_COLS


def cap_tasks(records: DataFrame, max_per_task: int | None) -> DataFrame:
    """First rows of every task by source index; none or 0 keeps all.

    ``idx`` counts a task's source rows from 0, so the cap is a plain filter
    that reaches the scan.
    """
    return records.filter(F.col("idx") < max_per_task) if max_per_task else records


def convert_records(records: DataFrame, max_per_task: int | None = None) -> DataFrame:
    """Evaluation rows, plus ``task``: one projection, unlabelled records dropped."""
    return (
        cap_tasks(records, max_per_task)
        .withColumn("_label", extract_label(F.col("response")))
        .filter(F.col("_label").isNotNull())
        .withColumn("_post", extract_post(F.col("query")))
        .select(
            "task",
            source_key(F.col("task"), F.col("idx"), F.col("_post")).alias("url"),
            F.col("_post").alias("description"),
            F.lit("").alias("transcript"),
            F.lit("").alias("suggested_words"),
            F.col("_label").alias("is_mental_health_handcoded"),
            extract_reasoning(F.col("response")).alias("rationale"),
            F.lit("test").alias("use"),
        )
        .select("task", *EVALUATION_COLS)
    )


def label_balance(rows: DataFrame, label_col: str = "is_mental_health_handcoded") -> DataFrame:
    """TRUE and FALSE rows per task and overall (task ``ALL``)."""
    return (
        rows.rollup("task")
        .agg(
            F.grouping("task").alias("_all"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(label_col) == "TRUE").alias("n_true"),
            F.count_if(F.col(label_col) == "FALSE").alias("n_false"),
        )
        .select(
            F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("task")).alias("task"),
            "n_rows",
            "n_true",
            "n_false",
            F.try_divide("n_true", "n_rows").alias("share_true"),
        )
    )
