"""The log of evaluation runs: a typed table that is only appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUN_LOG_SCHEMA = (
    "timestamp timestamp, stage string, model string, backend string, accuracy double, "
    "total bigint, tp bigint, tn bigint, fp bigint, fn bigint, precision double, recall double, "
    "rows_per_sec double, elapsed_sec double, n_examples bigint, prompt_hash string, "
    "concurrency bigint, assembled_hash string"
)


def append_run(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
