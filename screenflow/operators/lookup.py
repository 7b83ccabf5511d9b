"""Joins to a table with unique keys when some keys of the other side are very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HOT_KEYS = 100
SAMPLE_ROWS = 200_000
SAMPLE_PER_KEY = 100


def hot_keys(rows: DataFrame, key: str = "url") -> list[str]:
    """Keys that hold more than half of an even shuffle partition, so at most two for each partition.

    With few partitions a key counts from a hundredth of the rows on. The shares
    come from a sample of the key column, which grows with the partitions. They
    only decide how a join is spread over tasks; the join itself sees every row.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_HOT_KEYS, 2 * partitions)
    total = rows.count()
    if total == 0:
        return []
    keys = rows.select(key).filter(F.col(key).isNotNull())
    share = min(1.0, max(SAMPLE_ROWS, SAMPLE_PER_KEY * most) / total)
    sampled = keys if share == 1.0 else keys.sample(share, seed=17)
    expected = total * share / most
    frequent = sampled.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(expected, 1.0))
    return [r[key] for r in frequent.orderBy(F.desc("n"), key).limit(most).collect()]


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    how: str = "inner",
    key: str = "url",
    hot: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has every key at most once.

    Rows of a hot key are spread by the task they come from, and the key's one
    lookup row is repeated for every share. Other keys join as usual. The share
    depends on the input partition alone, so a task that is run again sends its
    rows to the same places.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(lookup, key, how)
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(key).isin(*hot)
    spread = F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(shares))).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0)))
    return (
        rows.withColumn("_share", spread)
        .join(lookup.withColumn("_share", F.explode(copies)), [key, "_share"], how)
        .drop("_share")
    )
