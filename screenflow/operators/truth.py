"""Checks and splits of a hand-coded truth table."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.functions.strings import strip
from screenflow.spec import LABELS

USES = ("train", "test")
MAX_REPORTED = 20


def require_columns(truth: DataFrame, truth_col: str) -> None:
    missing = sorted({"url", truth_col, "use"} - set(truth.columns))
    if missing:
        raise ValueError(f"truth table lacks columns: {', '.join(missing)}")


def normalise_truth(truth: DataFrame, truth_cols: Sequence[str]) -> DataFrame:
    """Trim and upper-case the label columns present, trim and lower-case ``use``."""
    cleaned = {c: F.upper(strip(F.col(c))) for c in truth_cols if c in truth.columns}
    return truth.withColumns({**cleaned, "use": F.lower(strip(F.col("use")))})


def truth_issues(truth: DataFrame, truth_col: str) -> DataFrame:
    """``(check, value, n)`` of a normalised truth table, from a single pass.

    A missing label only leaves the row out; the other checks are errors, and
    they look at the rows that have a label.
    """
    label, use = F.col(truth_col), F.col("use")
    present = label.isNotNull()

    def issue(name: str, value) -> F.Column:
        return F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"))

    found = F.array_compact(
        F.array(
            F.when(~present, issue("missing_label", F.lit(None))),
            F.when(present & ~label.isin(*LABELS), issue("invalid_label", label)),
            F.when(present & ~F.coalesce(use, F.lit("")).isin(*USES), issue("invalid_use", use)),
        )
    )
    return (
        truth.select(F.explode(found).alias("issue"))
        .groupBy("issue.check", "issue.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def truth_report(truth: DataFrame, truth_col: str) -> DataFrame:
    """``(check, value, n)`` of all that `validate_truth` and an evaluation would stop at.

    Besides the issues of the rows: columns that are missing (then nothing else can be
    checked), and a table without rows or without test rows that have a label. Takes a
    table as it was read.
    """
    missing = sorted({"url", truth_col, "use"} - set(truth.columns))
    if missing:
        rows = [("missing_column", c, 0) for c in missing]
        return truth.sparkSession.createDataFrame(rows, "check string, value string, n bigint")
    clean = normalise_truth(truth, [truth_col])
    testable = (F.col("use") == "test") & F.col(truth_col).isNotNull()
    none = clean.agg(F.count(F.lit(1)).alias("rows"), F.count_if(testable).alias("tests"))
    checks = F.array_compact(
        F.array(
            F.when(F.col("rows") == 0, F.lit("no_rows")),
            F.when(F.col("tests") == 0, F.lit("no_test_rows")),
        )
    )
    empty = none.select(F.explode(checks).alias("check"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n"))
    return truth_issues(clean, truth_col).union(empty)


def validate_truth(truth: DataFrame, truth_col: str) -> DataFrame:
    """Rows with a label, or an error that names the most frequent bad values."""
    require_columns(truth, truth_col)
    issues = truth_issues(truth, truth_col)
    worst = (
        issues.orderBy((F.col("check") != "missing_label").cast("int"), F.desc("n"), "check", "value")
        .limit(MAX_REPORTED + 1)
        .collect()
    )
    errors = [f"{r['check']} {r['value']!r} ({r['n']} rows)" for r in worst if r["check"] != "missing_label"]
    if errors:
        more = issues.filter(F.col("check") != "missing_label").count() - len(errors)
        rest = f"; and {more} more values" if more else ""
        raise ValueError(f"truth table is invalid: {'; '.join(errors)}{rest}")
    for r in worst:
        warnings.warn(f"dropping {r['n']} rows with missing {truth_col}", stacklevel=2)
    return truth.filter(F.col(truth_col).isNotNull())


def train_rows(truth: DataFrame) -> DataFrame:
    return truth.filter(F.col("use") == "train")


def held_out_rows(truth: DataFrame) -> DataFrame:
    return truth.filter(F.col("use") == "test")
