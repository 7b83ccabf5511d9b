"""Evaluate a scorer on the held-out rows of a truth table."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.operators import evaluate as ev
from screenflow.operators.rows import is_failed, row_filter
from screenflow.operators.score import PRESET, Scorer
from screenflow.operators.truth import held_out_rows, normalise_truth, train_rows, validate_truth, require_columns
from screenflow.sources.runlog import append_run
from screenflow.sources.scratch import scratch_folder
from screenflow.sources.truth import write_csv
from screenflow.spec import SKIPPED, STAGES, Settings, StageSpec


@dataclass(frozen=True)
class Evaluation:
    counts: DataFrame
    metrics: DataFrame
    matrix: DataFrame
    detail: DataFrame
    mismatches: DataFrame
    run: DataFrame


def evaluate_stage(
    spark: SparkSession,
    truth: DataFrame,
    stage: StageSpec,
    settings: Settings,
    scorer: Scorer,
    *,
    system_prompt: str = "",
    ord_col: str = "ord",
    use_examples: bool = False,
    detail_path: str | None = None,
    log_path: str | None = None,
) -> Evaluation:
    """Score the test rows once, store the predictions, and compare them to the truth.

    All reports read the stored predictions, so the scorer never runs twice.
    There is no gate here; ``settings.row_filter`` narrows the rows if asked to.
    """
    truth_cols = {s.truth_col for s in STAGES.values()} | {stage.truth_col}
    require_columns(truth, stage.truth_col)
    valid = validate_truth(normalise_truth(truth, sorted(truth_cols)), stage.truth_col)
    # Stored once: several reports read parts of it, and a CSV has to be parsed whole.
    truth_path = scratch_folder(spark, "truth")
    valid.write.parquet(truth_path)
    valid = spark.read.schema(valid.schema).parquet(truth_path)
    test = held_out_rows(valid)
    if test.isEmpty():
        raise ValueError("no rows with use=test in the truth table")

    started = time.perf_counter()
    texts = [c for c in settings.cols if c in test.columns]
    preset = F.when(is_failed(test), F.lit(SKIPPED)).alias(PRESET)
    rows = row_filter(test, settings.row_filter).select("url", *texts, preset)
    path = scratch_folder(spark, "predictions")
    scorer.label(rows, stage, settings, system_prompt).select(
        "url", "label", "prob_true", "rationale"
    ).write.parquet(path)
    predictions = spark.read.parquet(path)

    lookup = ev.truth_lookup(test, stage.truth_col, ord_col)
    counts = ev.confusion_counts(predictions, lookup)
    first = counts.first()
    elapsed = time.perf_counter() - started
    if first["total"] == 0:
        warnings.warn(
            f"no row got a label ({first['left_out']} unknown, skipped or too long); nothing is logged",
            stacklevel=2,
        )
        detail_path = log_path = None

    detail = ev.evaluation_detail(
        predictions if settings.rationale else predictions.drop("rationale"), lookup
    )
    n_examples = train_rows(valid).count() if use_examples else 0
    run = ev.run_row(counts, stage, settings, n_examples, elapsed, system_prompt)
    if detail_path:
        write_csv(detail, detail_path)
    if log_path:
        append_run(run, log_path)
    return Evaluation(
        counts,
        ev.with_metrics(counts),
        ev.confusion_matrix(counts),
        detail,
        ev.mismatches(detail),
        run,
    )
