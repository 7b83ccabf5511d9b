"""Results of several models side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.functions.strings import named
from screenflow.spec import LABELS, Settings, StageSpec


def wide_results(
    results: DataFrame, models: Sequence[Settings], stages: Sequence[StageSpec]
) -> DataFrame:
    """One row per key with the result columns of every model.

    The pivot is a single aggregate with one conditional column per stage and
    model. ``prob_true`` is that of the last stage that scored the row.
    """
    columns = []
    for settings in models:

        def cell(stage: StageSpec, value: str, model: str = settings.model_label):
            mine = (F.col("stage") == stage.name) & (F.col("model_label") == model)
            return F.max(F.when(mine, F.col(value)))

        for stage in stages:
            columns.append(cell(stage, "label").alias(settings.output_name(stage)))
            if settings.rationale:
                columns.append(cell(stage, "rationale").alias(settings.rationale_name(stage)))
        probs = [cell(stage, "prob_true") for stage in reversed(stages)]
        columns.append(F.coalesce(*probs).alias(settings.prob_name))
    return results.groupBy("url").agg(*columns)


def long_results(
    wide: DataFrame, models: Sequence[Settings], stages: Sequence[StageSpec]
) -> DataFrame:
    """Result columns of a wide table as ``(url, stage, model_label, label, prob_true, rationale)``.

    The inverse of `wide_results`, also for taking over a table that holds
    results already. A shared probability belongs to the last stage scored.
    """
    cells = []
    for settings in models:
        later = F.lit(False)
        for stage in reversed(stages):
            if settings.output_name(stage) not in wide.columns:
                continue
            label = named(settings.output_name(stage))
            has_prob = settings.prob_name in wide.columns
            prob = named(settings.prob_name) if has_prob else F.lit(None)
            reason = settings.rationale_name(stage)
            cells.append(
                F.struct(
                    F.lit(stage.name).alias("stage"),
                    F.lit(settings.model_label).alias("model_label"),
                    label.alias("label"),
                    F.when(~later, prob).cast("double").alias("prob_true"),
                    (named(reason) if reason in wide.columns else F.lit(None))
                    .cast("string")
                    .alias("rationale"),
                )
            )
            later = later | label.isNotNull()
    return wide.select("url", F.inline(F.array(*cells))).filter(F.col("label").isNotNull())


def model_agreement(
    wide: DataFrame, models: Sequence[Settings], stage: StageSpec
) -> DataFrame:
    """Add how many models labelled the row and how many said ``TRUE``."""
    labels = F.array_compact(F.array(*[named(m.output_name(stage)) for m in models]))
    n_true = F.size(F.filter(labels, lambda x: x == "TRUE")).cast("bigint")
    n_models = F.size(labels).cast("bigint")
    return wide.withColumns(
        {"n_models": n_models, "n_true": n_true, "agree": F.size(F.array_distinct(labels)) <= 1}
    )


def coincidences(results: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``first, second, weight``: how often two models give a row these labels, any number of models.

    A row with m labels counts each ordered pair of them 1 / (m - 1) times; rows with
    fewer than two, and labels outside ``labels``, are missing values. A row is reduced
    to its counts of labels, so the pairs are as many as the labels allow.
    """
    counted = [F.count_if(F.col("label") == x).alias(f"n{i}") for i, x in enumerate(labels)]
    per_row = results.groupBy("url").agg(*counted)
    n = [F.col(f"n{i}") for i in range(len(labels))]
    m = reduce(add, n)
    pairs = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (n[i] * (n[j] - int(i == j)) / (m - 1)).alias("weight"))
        for i, a in enumerate(labels)
        for j, b in enumerate(labels)
    ]
    return per_row.filter(m > 1).select(F.inline(F.array(*pairs))).groupBy("first", "second").agg(F.sum("weight").alias("weight"))


def agreement_alpha(results: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Krippendorff's alpha of nominal labels: one row ``n_values, observed, expected, alpha``.

    ``observed`` and ``expected`` are shares of pairs that disagree; alpha is
    1 - observed / expected, and null where all labels are the same or nothing is paired.
    """
    matrix = coincidences(results, labels)
    sizes = [F.sum(F.when(F.col("first") == x, F.col("weight")).otherwise(0.0)).alias(f"n{i}") for i, x in enumerate(labels)]
    apart = F.sum(F.when(F.col("first") != F.col("second"), F.col("weight")).otherwise(0.0)).alias("apart")
    n = [F.col(f"n{i}") for i in range(len(labels))]
    total = reduce(add, n)
    equal = reduce(add, [x * (x - 1) for x in n])
    expected = F.try_divide(total * (total - 1) - equal, total * (total - 1))
    observed = F.try_divide(F.col("apart"), total)
    return matrix.agg(*sizes, apart).select(
        F.coalesce(total, F.lit(0.0)).alias("n_values"), observed.alias("observed"), expected.alias("expected"),
        (1 - F.try_divide(observed, expected)).alias("alpha"),
    )
