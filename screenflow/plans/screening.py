"""Resumable runs of one or both stages into the results table."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.functions.strings import named
from screenflow.operators.lookup import join_lookup
from screenflow.operators.resume import batch_of, one_per_key, one_row_per_key, row_rank, stage_batches
from screenflow.operators.rows import is_failed, matches
from screenflow.operators.score import PRESET, Scorer
from screenflow.sources.metadata import require_key
from screenflow.sources.progress import RunProgress
from screenflow.sources.results import latest, read_attempts, read_commits, read_results, write_results
from screenflow.sources.scratch import scratch_folder, stored
from screenflow.spec import CLASSIFY, SCREEN, SKIPPED, Settings, StageSpec

FAILED, WANTED, GATED, ALL_FAILED = "_failed", "_wanted", "_gated", "_all_failed"
CONTENT = "_content"
# Stands for every content: results that were stored without one.
ANY_CONTENT = "*"
# Rows that a model labels between two commits, unless a run says otherwise.
COMMIT_ROWS = 1_000_000


def prepare_rows(videos: DataFrame, settings: Settings, ord_col: str | None = None) -> DataFrame:
    """The texts of every row with what decides about it: failed, wanted, rank among copies.

    With ``rescore_changed`` also a digest of the texts.
    """
    texts = [c for c in settings.cols if c in videos.columns]
    failed = is_failed(videos)
    digest = F.md5(F.to_json(F.struct(*[named(c).alias(c) for c in texts])).cast("binary"))
    return require_key(videos).select(
        "url",
        *texts,
        row_rank(videos, ord_col, texts).alias("_rank"),
        failed.alias(FAILED),
        matches(videos, settings.row_filter).alias(WANTED),
        F.when(failed, F.lit(SKIPPED)).alias(PRESET),
        *([digest.alias(CONTENT)] if settings.rescore_changed else []),
    )


def open_keys(rows: DataFrame, done: DataFrame, gate: DataFrame | None) -> DataFrame:
    """Keys without a result that this stage has to look at, and whether the gate let them in.

    A key is marked as failed, whatever the gate says, if all its rows failed.
    Only keys and flags of ``rows`` move here, to the buckets of the results, which stay.
    If the rows have a digest, a key is open too if ``done`` has it with other contents only.
    """
    all_failed = F.bool_and(FAILED).alias(ALL_FAILED)
    if CONTENT in rows.columns:
        now = F.min_by(CONTENT, "_rank").alias(CONTENT)
        contents = F.collect_set(F.coalesce("content", F.lit(ANY_CONTENT))).alias("_known")
        keys = rows.groupBy("url").agg(all_failed, now)
        met = keys.join(done.groupBy("url").agg(contents), "url", "left")
        settled_now = F.arrays_overlap("_known", F.array(F.col(CONTENT), F.lit(ANY_CONTENT)))
        pending = met.filter(~F.coalesce(settled_now, F.lit(False)))
    else:
        pending = rows.groupBy("url").agg(all_failed).join(done.select("url"), "url", "left_anti")
    if gate is None:
        return pending.select("url", ALL_FAILED, F.lit(True).alias(GATED))
    passed = gate.select("url", F.lit(True).alias(GATED))
    return (
        pending.join(passed, "url", "left")
        .withColumn(GATED, F.coalesce(GATED, F.lit(False)))
        .filter(F.col(ALL_FAILED) | F.col(GATED))
        .select("url", ALL_FAILED, GATED)
    )


def choose(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The rows that are due: those of failed keys to be marked, and wanted ones behind the gate.

    Without ``keys`` every row is looked at; a key's failed rows rank last there. Stored
    ``keys`` are broadcast if they are small; else both sides are shuffled and the
    adaptive join splits frequent keys.
    """
    if keys is None:
        due = rows.filter(F.col(FAILED) | F.col(WANTED))
    else:
        known = rows.join(keys, "url")
        marked = F.col(FAILED) & F.col(ALL_FAILED)
        due = known.filter(marked | (~F.col(FAILED) & F.col(WANTED) & F.col(GATED)))
        due = due.drop(GATED, ALL_FAILED)
    return due.drop(FAILED, WANTED)


def settled(
    spark: SparkSession, results_path: str, stage: StageSpec, settings: Settings
) -> DataFrame:
    """``url, content`` of what is not tried again: the last label, and what failed ``max_tries`` times."""
    done = read_results(spark, results_path, stage.name, settings.model_label)
    if settings.rescore_changed:
        done = latest(done)
    done = done.select("url", "content")
    if settings.max_tries is None:
        return done
    tries = read_attempts(spark, results_path, stage.name, settings.model_label)
    return done.union(tries.filter(F.col("try") == settings.max_tries).select("url", "content"))


def passed_gate(
    spark: SparkSession, results_path: str, stage: StageSpec, settings: Settings
) -> DataFrame | None:
    """Keys this model's earlier stage labelled ``TRUE``; a row filter replaces the gate."""
    if not stage.gate or settings.row_filter is not None:
        return None
    results = read_results(spark, results_path, stage.gate, settings.model_label)
    if settings.rescore_changed:
        results = latest(results)
    return results.filter(F.col("label") == "TRUE")


def run_stage(
    spark: SparkSession,
    videos: DataFrame,
    results_path: str,
    stage: StageSpec,
    settings: Settings,
    scorer: Scorer,
    *,
    system_prompt: str = "",
    ord_col: str | None = None,
    n_batches: int | None = None,
    commit_rows: int = COMMIT_ROWS,
    run_id: str | None = None,
    unique_keys: bool = False,
    progress_path: str | None = None,
) -> str:
    """Score what is pending for this stage and model; returns the run id.

    A row function labels in one scan of the texts that are due, and its labels are
    committed at once, in ``n_batches`` (default 1). Any other scorer commits after about
    ``commit_rows`` rows (or in ``n_batches``): the due rows are staged once, cut by key
    hash, and a run that dies loses one batch. ``unique_keys`` promises that no key
    occurs twice and saves a shuffle. ``progress_path`` gets a row of counts, rate and
    time left with every commit.
    """
    run_id = run_id or uuid.uuid4().hex[:12]
    commits = read_commits(spark, results_path, stage.name, settings.model_label)
    if not commits.filter(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id!r} exists; a new run needs a new id")
    gate = passed_gate(spark, results_path, stage, settings)
    rows = prepare_rows(videos, settings, ord_col)
    keys = None
    if gate is not None or settings.row_filter is not None or not commits.isEmpty():
        keys = stored(open_keys(rows, settled(spark, results_path, stage, settings), gate), "keys")
    due = choose(rows, keys)

    def label(part: DataFrame) -> DataFrame:
        return scorer.label(part, stage, settings, system_prompt)

    n_due = None
    if progress_path or not (scorer.row_function or n_batches):
        n_due = videos.count() if keys is None else keys.count()
    log = progress_path and RunProgress(spark, progress_path, stage.name, settings.model_label, run_id, n_due)

    def write(scored: DataFrame, batch_id: int = 0, **batches) -> None:
        sizes = write_results(
            scored, results_path, stage.name, settings.model_label, run_id, batch_id, **batches
        )
        for batch, (n_rows, n_failed) in sizes.items():
            if log:
                log.add(batch, n_rows, n_failed)

    if scorer.row_function:
        scored = label(due)
        n = n_batches or 1
        write(scored if unique_keys else one_per_key(scored), n_batches=n, batch_of=batch_of(n))
        return run_id
    unique = due.drop("_rank") if unique_keys else one_row_per_key(due)
    if n_batches is None:
        n_batches = max(1, math.ceil(n_due / commit_rows))
    if n_batches == 1:
        write(label(unique))
        return run_id
    staged = stage_batches(unique, scratch_folder(spark, "pending"), n_batches)
    for batch_id in range(n_batches):
        write(label(staged.filter(F.col("batch_id") == batch_id).drop("batch_id")), batch_id)
    return run_id


def run_two_pass(
    spark: SparkSession,
    videos: DataFrame,
    results_path: str,
    settings: Settings,
    scorer: Scorer,
    *,
    prompts: dict[str, str] | None = None,
    stages: Sequence[StageSpec] = (SCREEN, CLASSIFY),
    **options,
) -> list[str]:
    """Screen, then classify what passed. Each pass is stored before the next reads it."""
    prompts = prompts or {}
    return [
        run_stage(
            spark, videos, results_path, stage, settings, scorer,
            system_prompt=prompts.get(stage.name, ""), **options,
        )
        for stage in stages
    ]


def labels_for_rows(
    videos: DataFrame, results: DataFrame, stage: StageSpec, settings: Settings
) -> DataFrame:
    """Join stored labels back to every row of the table, copies of a key included."""
    mine = results.filter(
        (F.col("stage") == stage.name) & (F.col("model_label") == settings.model_label)
    ).select(
        "url",
        F.col("label").alias(settings.output_name(stage)),
        F.col("prob_true").alias(settings.prob_name),
    )
    return join_lookup(videos, mine, "left")
