"""Incremental runs: score the files that arrived since the last run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screenflow.operators.resume import one_per_key, one_row_per_key
from screenflow.operators.score import Scorer
from screenflow.plans.screening import choose, open_keys, passed_gate, prepare_rows
from screenflow.sources.progress import EpochLog, append_progress
from screenflow.sources.results import latest, read_results, write_results
from screenflow.sources.scratch import stored
from screenflow.spec import Settings, StageSpec

# Events of a stream reach its listener a little after it ended.
LISTENER_WAIT_SEC = 30


def run_incremental(
    spark: SparkSession,
    source_folder: str,
    source_schema: StructType | str,
    results_path: str,
    checkpoint: str,
    stage: StageSpec | Sequence[StageSpec],
    settings: Settings,
    scorer: Scorer,
    *,
    run_id: str,
    to_videos: Callable[[DataFrame], DataFrame] = lambda df: df,
    system_prompt: str = "",
    prompts: dict[str, str] | None = None,
    ord_col: str | None = None,
    glob: str = "*.parquet",
    max_files: int | None = None,
    progress_path: str | None = None,
) -> None:
    """Drain the new files of a folder into the results table, then stop.

    The stream's checkpoint remembers which files were read. The epoch is the
    batch id, so an epoch that is replayed after a failure replaces its own
    batch; its rows are compared with all results but that batch.
    ``run_id`` names the checkpoint and must stay with it. Files must arrive
    under new names: one that is rewritten in place is not read again. Rows a
    scorer failed on are not stored; `run_stage` over the folder picks them up.

    With several stages, each epoch goes through all of them in turn, so a later
    stage sees what the earlier one has just labelled. A gated stage alone fails
    on rows that the earlier stage has not looked at, and reads them again in the
    next run. ``prompts`` has a system prompt for each stage by name. ``progress_path`` gets
    a row for each stage of an epoch when it is committed, and for each epoch that ends.
    """
    began = time.monotonic()
    stages = [stage] if isinstance(stage, StageSpec) else list(stage)
    together = {s.name for s in stages}
    reader = spark.readStream.schema(source_schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def score_epoch(arrived: DataFrame, epoch: int) -> None:
        rows = prepare_rows(to_videos(arrived), settings, ord_col)
        # The history meets the keys of the epoch before anything else.
        arrived_keys = stored(rows.select("url").distinct(), "arrived")
        if log:
            log.arrived[epoch] = arrived.count()
        for each in stages:
            score_stage(arrived.sparkSession, rows, arrived_keys, each, epoch)

    def score_stage(
        session: SparkSession, rows: DataFrame, arrived_keys: DataFrame, each: StageSpec, epoch: int
    ) -> None:
        def known(name: str) -> DataFrame:
            results = read_results(session, results_path, name, settings.model_label)
            return results.join(arrived_keys, "url", "left_semi")

        own = (F.col("run_id") == run_id) & (F.col("batch_id") == epoch)
        done = known(each.name).filter(~own)
        if settings.rescore_changed:
            done = latest(done)
        gate = passed_gate(session, results_path, each, settings)
        if gate is not None:
            if each.gate not in together:
                seen = known(each.gate).select("url").union(done.select("url"))
                if not rows.select("url").distinct().join(seen, "url", "left_anti").isEmpty():
                    raise RuntimeError(f"rows that stage {each.gate!r} has not looked at; run it first")
            gate = gate.join(arrived_keys, "url", "left_semi")
        prompt = (prompts or {}).get(each.name, system_prompt)
        due = choose(rows, stored(open_keys(rows, done, gate), "keys"))
        if scorer.row_function:
            scored = one_per_key(scorer.label(due, each, settings, prompt))
        else:
            scored = scorer.label(one_row_per_key(due), each, settings, prompt)
        sizes = write_results(scored, results_path, each.name, settings.model_label, run_id, epoch)
        if progress_path:
            n_rows, n_failed = sizes[epoch]
            names = (each.name, settings.model_label, run_id)
            elapsed = time.monotonic() - began
            append_progress(session, progress_path, *names, epoch, n_rows, n_failed, n_rows, None, elapsed)

    name = f"screenflow-{uuid.uuid4().hex}"
    log = progress_path and EpochLog(spark, progress_path, name, settings.model_label, run_id)
    if log:
        spark.streams.addListener(log)
    try:
        query = (
            reader.parquet(source_folder)
            .writeStream.foreachBatch(score_epoch)
            .queryName(name)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if log:
            log.ended.wait(LISTENER_WAIT_SEC)
            spark.streams.removeListener(log)
