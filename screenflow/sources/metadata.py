"""The metadata table: scan, sample slice and result listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.functions.strings import named
from screenflow.operators.rows import drop_model_columns, exclude_failed
from screenflow.spec import TEXT_COLS, Settings, StageSpec

METADATA_COLS = ("url", *TEXT_COLS, "scrape_status")


def read_metadata(
    spark: SparkSession,
    path: str,
    cols: Sequence[str] = METADATA_COLS,
    partitions: int | None = None,
) -> DataFrame:
    """The wanted columns that exist; the scan reads nothing else.

    ``partitions`` spreads the rows of a file with a single row group, which
    one task would read and score; large tables need no such shuffle.
    """
    table = spark.read.parquet(path)
    wanted = table.select(*[c for c in cols if c in table.columns])
    return wanted.repartition(partitions) if partitions else wanted


def require_key(df: DataFrame, key: str = "url") -> DataFrame:
    """Fail the job, not silently merge rows, when a row has no key."""
    return df.withColumn(
        key, F.coalesce(F.col(key), F.raise_error(F.lit(f"row without {key}")).cast("string"))
    )


def sample_slice(table: DataFrame, n: int, order_by: str, model_label: str) -> DataFrame:
    """First ``n`` usable rows without this model's columns, for a trial run."""
    usable = exclude_failed(table).orderBy(order_by).limit(n)
    return drop_model_columns(usable, model_label)


def result_listing(
    wide: DataFrame, settings: Settings, screen: StageSpec, classify: StageSpec
) -> DataFrame:
    """The key and those of this model's result columns that exist."""
    wanted = [
        "url",
        settings.output_name(screen),
        settings.output_name(classify),
        settings.rationale_name(classify),
    ]
    return wide.select(*[named(c) for c in wanted if c in wide.columns])
