"""Row predicates and result columns of the wide metadata table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenflow.functions.strings import named
from screenflow.spec import FAILED_STATUS, SKIPPED, TEXT_COLS, Settings, StageSpec


def ensure_result_columns(
    df: DataFrame, stage: StageSpec, settings: Settings
) -> DataFrame:
    """Add this model's output columns as nulls where the table lacks them."""
    wanted = {settings.output_name(stage): "string", settings.prob_name: "double"}
    if settings.rationale:
        wanted[settings.rationale_name(stage)] = "string"
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def is_failed(df: DataFrame) -> Column:
    """Null-safe test for a failed row; false where the status column is absent."""
    if "scrape_status" not in df.columns:
        return F.lit(False)
    return F.col("scrape_status").eqNullSafe(F.lit(FAILED_STATUS))


def content_key(df: DataFrame, cols: Sequence[str] = TEXT_COLS, key: str = "url") -> DataFrame:
    """``key`` extended by a digest of the texts and the status: ``key#digest``.

    For tables whose key repeats, is null or is absent: rows of a key that differ
    then get a result each, and only equal rows share one.
    """
    texts = [F.coalesce(named(c), F.lit("\0")) for c in cols if c in df.columns]
    status = F.when(is_failed(df), F.lit("failed")).otherwise(F.lit("usable"))
    digest = F.md5(F.concat_ws("\x1f", status, *texts))
    known = [named(key).cast("string")] if key in df.columns else []
    return df.withColumn(key, F.concat_ws("#", *known, digest))


def skip_failed(df: DataFrame, label_col: str) -> DataFrame:
    """Mark pending rows that failed upstream as final, so they are never scored."""
    label = named(label_col)
    marked = F.when(label.isNull() & is_failed(df), F.lit(SKIPPED)).otherwise(label)
    return df.withColumn(label_col, marked)


def exclude_failed(df: DataFrame) -> DataFrame:
    """Drop failed rows; rows with a null status stay."""
    return df.filter(~is_failed(df))


def matches(df: DataFrame, expression: str | None) -> Column:
    """``COL=VAL`` string equality, cut at the first ``=``; never null.

    Null never matches, and neither does a column that is not a string.
    """
    if not expression:
        return F.lit(True)
    name, _, value = expression.partition("=")
    if name not in df.columns:
        raise ValueError(f"no column {name!r} to filter on")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(False)
    return F.col(name).eqNullSafe(F.lit(value))


def row_filter(df: DataFrame, expression: str | None) -> DataFrame:
    return df.filter(matches(df, expression))


def drop_model_columns(df: DataFrame, model_label: str) -> DataFrame:
    """Drop every column whose name contains the model label."""
    return df.drop(*[c for c in df.columns if model_label in c])


def pending_counts(df: DataFrame, label_col: str, expression: str | None = None) -> DataFrame:
    """Rows pending, done and in total, in one aggregate after `skip_failed`."""
    pending = F.count_if(named(label_col).isNull() & matches(df, expression))
    total = F.count(F.lit(1))
    return df.agg(
        pending.alias("pending"), (total - pending).alias("done"), total.alias("total")
    )
