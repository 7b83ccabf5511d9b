"""Pending rows, batches, progress and label counts of resumable runs."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenflow.functions.strings import named
from screenflow.operators.rows import is_failed
from screenflow.sources.scratch import stored
from screenflow.spec import SKIPPED


def pending_rows(rows: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key has no result yet.

    The anti join moves distinct keys only. What it leaves is stored, so the planner
    knows its size when the texts meet it: late in a run few keys are pending, they are
    broadcast, and the texts are not shuffled at all.
    """
    pending = rows.select(key).distinct().join(done.select(key), key, "left_anti")
    return rows.join(stored(pending, "pending"), key, "left_semi")


def row_rank(df: DataFrame, ord_col: str | None, cols: list[str]) -> Column:
    """Which row of a key counts: usable before failed, then the lowest ``ord``, then the content hash."""
    last = F.lit(2**63 - 1)
    place = last if ord_col is None else F.coalesce(named(ord_col).cast("bigint"), last)
    content = F.xxhash64(F.lit(0), *[named(c) for c in cols if c in df.columns])
    return F.struct(
        is_failed(df).alias("failed"), place.alias("ord"), content.alias("content")
    )


def one_per_key(df: DataFrame, key: str = "url", rank: str = "_rank") -> DataFrame:
    """One row per key, by ``rank``; copies collapse on the map side before the shuffle."""
    rest = [c for c in df.columns if c not in (key, rank)]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(rank)).alias("_row"))
        .select(key, "_row.*")
    )


def one_row_per_key(df: DataFrame, key: str = "url", rank: str = "_rank") -> DataFrame:
    """`one_per_key` for rows with large texts: only those of repeated keys are grouped.

    The repeated keys are found on the key column and stored; where there are none, or
    few enough to broadcast, no other text is shuffled.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return df.drop(rank)
    single = df.join(repeated, key, "left_anti").drop(rank)
    return single.unionByName(one_per_key(df.join(repeated, key, "left_semi"), key, rank))


def batch_of(n_batches: int, key: str = "url") -> Column:
    """Even batches by key hash; the number needs no sort and no count."""
    return F.pmod(F.xxhash64(key), F.lit(n_batches)).cast("bigint")


def hash_batches(df: DataFrame, n_batches: int, key: str = "url") -> DataFrame:
    return df.withColumn("batch_id", batch_of(n_batches, key))


def stage_batches(
    rows: DataFrame, path: str, n_batches: int, key: str = "url"
) -> DataFrame:
    """Write the rows once, one folder per batch, and return the stored table.

    Every batch then reads its own folder only. Batches run one after another, so
    each is spread by a second hash of the key over as many files as the cluster
    has cores, and not over a file from every task.
    """
    session = rows.sparkSession
    total = int(session.conf.get("spark.sql.shuffle.partitions"))
    writers = max(math.ceil(total / n_batches), session.sparkContext.defaultParallelism)
    batched = hash_batches(rows, n_batches, key)
    (
        batched.withColumn("_writer", F.pmod(F.hash(key), F.lit(writers)))
        .repartition(n_batches * writers, "batch_id", "_writer")
        .drop("_writer")
        .write.partitionBy("batch_id")
        .parquet(path)
    )
    return rows.sparkSession.read.schema(batched.schema).parquet(path)


def exact_batches(
    df: DataFrame, order_col: str, batch_size: int, n_ranges: int | None = None
) -> DataFrame:
    """Blocks of exactly ``batch_size`` rows in the order of a unique ``order_col``.

    The order is cut into ranges at its quantiles, so ranks are taken per range
    in parallel and shifted by the sizes of the ranges before. Only the cut
    points and the range sizes (``n_ranges`` numbers) reach the driver.
    """
    ranges = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    quantiles = df.agg(F.percentile_approx(order_col, steps or [0.5]).alias("q")).first()["q"]
    cuts = F.array(*[F.lit(q) for q in sorted(set(quantiles or []))])
    ranged = df.withColumn(
        "_range", F.size(F.filter(cuts, lambda c: c < F.col(order_col)))
    )
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts, start = [], 0
    for i in range(max(sizes, default=0) + 1):
        starts.append(start)
        start += sizes.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_range") + 1)
    in_range = F.row_number().over(Window.partitionBy("_range").orderBy(order_col))
    return ranged.withColumn(
        "batch_id", F.floor((offset + in_range - 1) / batch_size).cast("bigint")
    ).drop("_range")


def batch_progress(
    results: DataFrame, n_pending: int, started: datetime | None = None
) -> DataFrame:
    """Rows done, share, rate and time left after every batch of a run.

    Time counts from ``started``, else from the end of the first batch. The
    window runs over one row per batch.
    """
    run = Window.partitionBy("stage", "model_label", "run_id")
    so_far = run.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.col("ended").cast("double")
    begin = F.min(ended).over(run) if started is None else F.lit(started).cast("double")
    elapsed = ended - begin
    rate = F.try_divide(F.col("done").cast("double"), F.col("elapsed_sec"))
    return (
        results.groupBy("stage", "model_label", "run_id", "batch_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("scored_at").alias("ended"))
        .withColumn("done", F.sum("n_rows").over(so_far))
        .withColumn("percent", F.try_divide(F.col("done") * 100.0, F.lit(n_pending)))
        .withColumn("elapsed_sec", elapsed)
        .withColumn("rows_per_sec", rate)
        .withColumn("eta_sec", F.try_divide(F.lit(n_pending) - F.col("done"), F.col("rows_per_sec")))
        .drop("ended")
    )


def label_summary(results: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per label, largest first, without pending and skipped rows."""
    return (
        results.filter(F.col(label_col).isNotNull() & (F.col(label_col) != SKIPPED))
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )
