"""Staged benchmark records and the evaluation file made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.sources.truth import write_csv
from screenflow.spec import BENCHMARK_TASKS

# Fixed value: the column order of the evaluation file.
EVALUATION_COLS = (
    "url", "description", "transcript", "suggested_words",
    "is_mental_health_handcoded", "rationale", "use",
)
# The reply column of a staged copy may carry the name of the model that wrote it.
RESPONSE_COLS = ("response", "gpt-3.5-turbo")


def select_tasks(records: DataFrame, tasks: Sequence[str] = BENCHMARK_TASKS) -> DataFrame:
    """``(task, idx, query, response)`` of the wanted tasks."""
    response = next((c for c in RESPONSE_COLS if c in records.columns), None)
    if response is None:
        raise ValueError(f"benchmark records lack a reply column: one of {', '.join(RESPONSE_COLS)}")
    return records.filter(F.col("task").isin(*tasks)).select(
        F.col("task").cast("string").alias("task"),
        F.col("idx").cast("bigint").alias("idx"),
        "query",
        F.col(f"`{response}`").alias("response"),
    )


def read_benchmark(
    spark: SparkSession,
    path: str,
    tasks: Sequence[str] = BENCHMARK_TASKS,
    file_format: str = "parquet",
) -> DataFrame:
    """Read a staged copy; where tasks are partition folders, only the wanted ones."""
    return select_tasks(spark.read.format(file_format).load(path), tasks)


def write_evaluation_file(rows: DataFrame, path: str) -> None:
    write_csv(rows.select(*EVALUATION_COLS), path, quote_all=True)
