"""Benchmark conversion from a staged copy to an evaluation file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from screenflow.operators.convert import convert_records, label_balance
from screenflow.sources.benchmark import read_benchmark, write_evaluation_file
from screenflow.spec import BENCHMARK_TASKS


def convert_benchmark(
    spark: SparkSession,
    source: str,
    target: str,
    tasks: Sequence[str] = BENCHMARK_TASKS,
    max_per_task: int | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """Write the evaluation file and return the label balance."""
    unknown = sorted(set(tasks) - set(BENCHMARK_TASKS))
    if unknown:
        raise ValueError(f"unknown tasks: {', '.join(unknown)}")
    rows = convert_records(read_benchmark(spark, source, tasks, file_format), max_per_task)
    if rows.isEmpty():
        raise ValueError("no labelled benchmark rows")
    write_evaluation_file(rows, target)
    return label_balance(rows)
