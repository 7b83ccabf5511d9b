"""Predictions against hand-coded truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.operators.lookup import join_lookup
from screenflow.operators.prompt import fingerprint
from screenflow.operators.rows import ensure_result_columns
from screenflow.operators.truth import held_out_rows
from screenflow.spec import LABELS, Settings, StageSpec


def evaluation_set(truth: DataFrame, stage: StageSpec, settings: Settings) -> DataFrame:
    """Held-out rows with this model's result columns reset to null."""
    stale = [settings.output_name(stage), settings.prob_name, settings.rationale_name(stage)]
    return ensure_result_columns(held_out_rows(truth).drop(*stale), stage, settings)


def truth_lookup(truth: DataFrame, truth_col: str, ord_col: str = "ord") -> DataFrame:
    """``(url, ground_truth)``, the last row of a key wins."""
    return truth.groupBy("url").agg(F.max_by(truth_col, ord_col).alias("ground_truth"))


def confusion_counts(
    predictions: DataFrame, lookup: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``tp, tn, fp, fn, total, left_out``: one row, or one per group of ``by``.

    The truth is joined first: a small one is broadcast by the planner, and the
    predictions are counted where they are. Beside a large one, the rows of a
    frequent key are split by the adaptive skew join.
    """
    label, actual = F.col("label"), F.col("ground_truth")

    def cell(predicted: str, truth: str) -> Column:
        return F.count_if((label == predicted) & (actual == truth))

    return (
        predictions.join(lookup, "url")
        .groupBy(*by)
        .agg(
            cell("TRUE", "TRUE").alias("tp"),
            cell("FALSE", "FALSE").alias("tn"),
            cell("TRUE", "FALSE").alias("fp"),
            cell("FALSE", "TRUE").alias("fn"),
            F.count_if(label.isin(*LABELS)).alias("total"),
            F.count_if(~F.coalesce(label, F.lit("")).isin(*LABELS)).alias("left_out"),
        )
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision and recall; null where the denominator is zero."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, F.col("total")),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
        }
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Predicted labels that occur, by actual label."""
    rows = F.array(
        F.struct(
            F.lit("FALSE").alias("predicted"), F.col("tn").alias("FALSE"), F.col("fn").alias("TRUE")
        ),
        F.struct(
            F.lit("TRUE").alias("predicted"), F.col("fp").alias("FALSE"), F.col("tp").alias("TRUE")
        ),
    )
    return counts.select(F.inline(rows)).filter(F.col("FALSE") + F.col("TRUE") > 0)


def evaluation_detail(
    predictions: DataFrame, lookup: DataFrame, hot: Sequence[str] | None = None
) -> DataFrame:
    """``url, predicted, ground_truth[, rationale]`` of the rows that got a label."""
    extra = ["rationale"] if "rationale" in predictions.columns else []
    labelled = predictions.filter(F.col("label").isin(*LABELS))
    return join_lookup(labelled, lookup, hot=hot).select(
        "url", F.col("label").alias("predicted"), "ground_truth", *extra
    )


def mismatches(detail: DataFrame) -> DataFrame:
    return detail.filter(F.col("predicted") != F.col("ground_truth"))


def run_row(
    counts: DataFrame,
    stage: StageSpec,
    settings: Settings,
    n_examples: int = 0,
    elapsed_sec: float | None = None,
    system_prompt: str = "",
) -> DataFrame:
    """The log row of an evaluation run.

    ``prompt_hash`` identifies the template, ``assembled_hash`` the prompt sent.
    """
    elapsed = F.lit(elapsed_sec).cast("double")
    assembled = fingerprint(system_prompt) if system_prompt else None
    return with_metrics(counts).select(
        F.current_timestamp().alias("timestamp"),
        F.lit(stage.name).alias("stage"),
        F.lit(settings.model).alias("model"),
        F.lit(settings.backend).alias("backend"),
        "accuracy", "total", "tp", "tn", "fp", "fn", "precision", "recall",
        F.try_divide(F.col("total").cast("double"), elapsed).alias("rows_per_sec"),
        elapsed.alias("elapsed_sec"),
        F.lit(n_examples).cast("bigint").alias("n_examples"),
        F.lit(fingerprint(stage.template)).alias("prompt_hash"),
        F.lit(settings.concurrency).cast("bigint").alias("concurrency"),
        F.lit(assembled).cast("string").alias("assembled_hash"),
    )


def best_runs(log: DataFrame) -> DataFrame:
    """Most accurate run per stage and model; ties go to the larger recall, then the later prompt hash."""
    rank = F.struct("accuracy", "recall", "prompt_hash")
    return log.groupBy("stage", "model").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max("accuracy").alias("best_accuracy"),
        F.max_by("prompt_hash", rank).alias("best_prompt"),
        F.max_by("recall", rank).alias("best_recall"),
    )
