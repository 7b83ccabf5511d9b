"""Live progress of runs: a table that gets a row with every commit, and with every epoch of a stream."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS_SCHEMA = (
    "stage string, model_label string, run_id string, batch_id bigint, n_rows bigint, n_failed bigint, "
    "done bigint, total bigint, elapsed_sec double, rows_per_sec double, eta_sec double, at timestamp"
)
#: The stage under which a stream logs the rows that arrived.
ARRIVED = "arrived"


def append_progress(
    spark: SparkSession, path: str, stage: str, model_label: str, run_id: str, batch_id: int,
    n_rows: int, n_failed: int, done: int, total: int | None, elapsed: float, rate: float | None = None,
) -> None:
    """Log one batch; time left follows from the rate so far, if the total is known."""
    rate = rate if rate is not None else (done / elapsed if elapsed > 0 else None)
    eta = (total - done) / rate if total is not None and rate else None
    row = (stage, model_label, run_id, batch_id, n_rows, n_failed, done, total, elapsed, rate, eta)
    given = PROGRESS_SCHEMA.rpartition(", ")[0]
    spark.createDataFrame([row], given).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every stage, model, run and batch: a batch that was replayed counts once."""
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    batch = ["stage", "model_label", "run_id", "batch_id"]
    rest = [c for c in rows.columns if c not in batch]
    return rows.groupBy(*batch).agg(F.max_by(F.struct(*rest), "at").alias("_last")).select(*batch, "_last.*")


class RunProgress:
    """Counts the batches of one run as they are committed and logs each at once."""

    def __init__(self, spark: SparkSession, path: str, stage: str, model_label: str, run_id: str, total: int | None):
        self.spark, self.path, self.total = spark, path, total
        self.names = (stage, model_label, run_id)
        self.began, self.done = time.monotonic(), 0

    def add(self, batch_id: int, n_rows: int, n_failed: int) -> None:
        self.done += n_rows
        elapsed = time.monotonic() - self.began
        append_progress(self.spark, self.path, *self.names, batch_id, n_rows, n_failed, self.done, self.total, elapsed)


class EpochLog(StreamingQueryListener):
    """Logs the rows and the rate of every epoch of the query with this name, while it runs.

    ``arrived`` holds the rows of each epoch: the event counts them once for every
    time that the epoch was read.
    """

    def __init__(self, spark: SparkSession, path: str, query_name: str, model_label: str, run_id: str):
        self.spark, self.path, self.query_name = spark, path, query_name
        self.names = (ARRIVED, model_label, run_id)
        self.query_id: str | None = None
        self.arrived: dict[int, int] = {}
        self.done, self.elapsed, self.ended = 0, 0.0, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.query_name:
            self.query_id = str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if progress.name != self.query_name or progress.batchId not in self.arrived:
            return
        n_rows = self.arrived.pop(progress.batchId)
        took = progress.durationMs.get("triggerExecution", 0) / 1000
        self.done += n_rows
        self.elapsed += took
        append_progress(
            self.spark, self.path, *self.names, progress.batchId, n_rows, 0,
            self.done, None, self.elapsed, n_rows / took if took else None,
        )

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == self.query_id:
            self.ended.set()
