"""The long, append-only results table that makes runs resumable.

One row per key, stage and model. Below the table's folder are

* ``data/generation=/buckets=/stage=/model_label=``: rows bucketed by ``url``, each with
  the run, the batch and the attempt that wrote it, and the error if it has no label;
* ``commits``: a row for each batch that is complete, naming the attempt that counts.

A batch is written first and committed last, by one file, so readers see a whole batch
or nothing of it. An attempt that died, or that a later one replaced, is never read;
`compact_results` writes what is visible to the next generation, in few files. Joins by
``url`` with the rows of one stage and model use their buckets and do not move them.
One writer at a time is assumed for a stage and model.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_COLS = "url string, label string, prob_true double, rationale string, scored_at timestamp, content string"
FILE_SCHEMA = f"{ROW_COLS}, error string, run_id string, batch_id bigint, attempt string"
PLACE_COLS = "generation bigint, buckets int, stage string, model_label string"
RESULT_SCHEMA = f"{ROW_COLS}, stage string, model_label string, run_id string, batch_id bigint"
COMMIT_SCHEMA = (
    "stage string, model_label string, run_id string, batch_id bigint, attempt string, "
    "generation bigint, buckets int, n_rows bigint, committed_at timestamp"
)
RESULT_COLS = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
ATTEMPT = ("run_id", "batch_id", "attempt")
# Up to as many commits, of about 100 bytes, are broadcast to the rows. With more, both sides
# are shuffled until `compact_results` or a larger batch brings the number down.
MAX_BROADCAST_COMMITS = 100_000
# Characters that cannot stand in the name of a partition folder as they are.
UNSAFE = set("\"#%'*/:=?\\{}[]^\x7f") | {chr(c) for c in range(32)}


@dataclass(frozen=True)
class Place:
    """Where the rows of one stage and model are."""

    path: str
    stage: str
    model_label: str
    generation: int
    buckets: int

    @property
    def folder(self) -> str:
        def safe(value: str) -> str:
            return "".join(f"%{ord(c):02X}" if c in UNSAFE else c for c in value)

        return (
            f"{self.path.rstrip('/')}/data/generation={self.generation}/buckets={self.buckets}"
            f"/stage={safe(self.stage)}/model_label={safe(self.model_label)}"
        )

    def table(self, spark: SparkSession) -> str:
        """The catalog name of the bucketed files; only a catalog table knows its buckets."""
        name = f"screenflow_{hashlib.md5(self.folder.encode()).hexdigest()}"
        location = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"create table if not exists {name} ({FILE_SCHEMA}) using parquet "
            f"clustered by (url) sorted by (url) into {self.buckets} buckets location '{location}'"
        )
        spark.catalog.refreshTable(name)
        return name


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _only(df: DataFrame, stage: str | None, model_label: str | None) -> DataFrame:
    if stage is not None:
        df = df.filter(F.col("stage") == stage)
    if model_label is not None:
        df = df.filter(F.col("model_label") == model_label)
    return df


def read_commits(
    spark: SparkSession, path: str, stage: str | None = None, model_label: str | None = None
) -> DataFrame:
    """The commit that counts of every batch: the latest of a stage and model's last generation."""
    commits = _only(_read(spark, f"{path}/commits", COMMIT_SCHEMA), stage, model_label)
    batch = ["stage", "model_label", "run_id", "batch_id"]
    rest = [c for c in commits.columns if c not in batch]
    order = F.struct("generation", "committed_at", "attempt")
    latest = commits.groupBy(*batch).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return latest.select(*batch, "_last.*")


def _place(spark: SparkSession, path: str, stage: str, model_label: str) -> tuple[Place | None, int]:
    """Where the current generation is, if there is one, and the number of commits."""
    commits = _only(_read(spark, f"{path}/commits", COMMIT_SCHEMA), stage, model_label)
    found = commits.agg(F.max(F.struct("generation", "buckets")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    last = found["p"]
    if last is None:
        return None, 0
    return Place(path, stage, model_label, last["generation"], last["buckets"]), found["n"]


def _visible(spark: SparkSession, path: str, stage: str | None, model_label: str | None) -> DataFrame:
    """All rows of committed batches, with and without a label."""
    commits = read_commits(spark, path, stage, model_label)
    if stage is not None and model_label is not None:
        place, n = _place(spark, path, stage, model_label)
        if place is None:
            return spark.createDataFrame([], f"{FILE_SCHEMA}, stage string, model_label string")
        rows = spark.table(place.table(spark))
        rows = rows.withColumns({"stage": F.lit(stage), "model_label": F.lit(model_label)})
        counted = commits.select(*ATTEMPT)
        counted = F.broadcast(counted) if n <= MAX_BROADCAST_COMMITS else counted
        return rows.join(counted, list(ATTEMPT), "left_semi")
    rows = _only(_read(spark, f"{path}/data", f"{FILE_SCHEMA}, {PLACE_COLS}"), stage, model_label)
    keys = ["generation", "stage", "model_label", *ATTEMPT]
    return rows.join(commits.select(*keys), keys, "left_semi")


def read_results(
    spark: SparkSession, path: str, stage: str | None = None, model_label: str | None = None
) -> DataFrame:
    """Committed results of one stage and model, or of all; empty before the first commit.

    With both given only their folder is read, and joins by ``url`` use its buckets.
    """
    return _visible(spark, path, stage, model_label).filter(F.col("label").isNotNull()).select(*RESULT_COLS)


def read_attempts(
    spark: SparkSession, path: str, stage: str | None = None, model_label: str | None = None
) -> DataFrame:
    """Every try that gave no label: ``url, try, error, tried_at`` with its stage, model, run and batch.

    Tries are counted for each content of a key.
    """
    failed = _visible(spark, path, stage, model_label).filter(F.col("label").isNull())
    key = Window.partitionBy("url", "content", "stage", "model_label")
    order = key.orderBy("scored_at", "run_id", "batch_id")
    return failed.select(
        "url", F.row_number().over(order).alias("try"), "error", F.col("scored_at").alias("tried_at"),
        "content", "stage", "model_label", "run_id", "batch_id",
    )


def latest(results: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One row for each key, stage and model: the last one scored, or the last until ``as_of``.

    Only rows that were scored again because their texts changed have several.
    """
    if as_of is not None:
        results = results.filter(F.col("scored_at") <= F.lit(as_of))
    key = ["url", "stage", "model_label"]
    rest = [c for c in results.columns if c not in key]
    order = F.struct("scored_at", "run_id", "batch_id")
    last = results.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*key, "_last.*").select(*results.columns)


def commit(spark: SparkSession, place: Place, attempt: str, batches: Sequence[tuple[str, int, int]]) -> None:
    """Make the batches ``(run_id, batch_id, n_rows)`` of an attempt visible, all at once: one file."""
    rows = [
        (place.stage, place.model_label, run_id, batch_id, attempt, place.generation, place.buckets, n)
        for run_id, batch_id, n in batches
    ]
    given = COMMIT_SCHEMA.rpartition(", ")[0]
    marked = spark.createDataFrame(rows, given).withColumn("committed_at", F.current_timestamp())
    marked.coalesce(1).write.mode("append").parquet(f"{place.path}/commits")


def append_rows(rows: DataFrame, place: Place) -> None:
    """Write rows as they are, one file for each bucket that has any; nobody reads them before `commit`."""
    spark = rows.sparkSession
    columns = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
    rows.select(*columns).repartition(place.buckets, "url").write.insertInto(place.table(spark))


def _batch_sizes(spark: SparkSession, place: Place, attempt: str) -> dict[int, tuple[int, int]]:
    written = spark.table(place.table(spark)).filter(F.col("attempt") == attempt)
    sizes = written.groupBy("batch_id").agg(F.count("label").alias("n"), F.count("error").alias("failed")).collect()
    return {r["batch_id"]: (r["n"], r["failed"]) for r in sizes}


def write_results(
    scored: DataFrame,
    path: str,
    stage: str,
    model_label: str,
    run_id: str,
    batch_id: int = 0,
    *,
    n_batches: int | None = None,
    batch_of: Column | None = None,
) -> dict[int, tuple[int, int]]:
    """Write ``(url, label, prob_true, rationale[, error, _content])`` rows and commit them as one batch.

    With ``n_batches`` and ``batch_of``, the number of each row's batch, they are written
    at once and committed as that many batches. A batch that is written again replaces
    its former attempt. Rows without a label stay pending; `read_attempts` shows them.
    Returns each batch's rows with and without a label.
    """
    spark = scored.sparkSession
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = _place(spark, path, stage, model_label)[0] or Place(path, stage, model_label, 0, default)
    attempt = uuid.uuid4().hex
    error = F.coalesce(F.col("error"), F.lit("no label")) if "error" in scored.columns else F.lit("no label")
    batch = F.lit(batch_id) if batch_of is None else batch_of
    content = F.col("_content") if "_content" in scored.columns else F.lit(None)
    rows = scored.select(
        "url", "label", "prob_true", "rationale", F.current_timestamp().alias("scored_at"),
        content.cast("string").alias("content"),
        F.when(F.col("label").isNull(), error).alias("error"),
        F.lit(run_id).alias("run_id"), batch.cast("bigint").alias("batch_id"), F.lit(attempt).alias("attempt"),
    )
    append_rows(rows, place)
    batches = [batch_id] if n_batches is None else range(n_batches)
    sizes = {b: (0, 0) for b in batches} | _batch_sizes(spark, place, attempt)
    commit(spark, place, attempt, [(run_id, b, n + failed) for b, (n, failed) in sizes.items()])
    return sizes


def compact_results(
    spark: SparkSession, path: str, stage: str, model_label: str, buckets: int | None = None
) -> None:
    """Write what is visible of a stage and model to its next generation, one file a bucket.

    ``buckets`` may change their number. Readers go over to the new generation with its
    commit; the old one is no longer read and can be deleted.
    """
    place, _ = _place(spark, path, stage, model_label)
    if place is None:
        return
    following = Place(path, stage, model_label, place.generation + 1, buckets or place.buckets)
    attempt = uuid.uuid4().hex
    rows = _visible(spark, path, stage, model_label).withColumn("attempt", F.lit(attempt))
    commits = read_commits(spark, path, stage, model_label).select("run_id", "batch_id", "n_rows").collect()
    append_rows(rows, following)
    commit(spark, following, attempt, [tuple(r) for r in commits])
