"""Mixing sources to target weights by Poisson replication.

A source's rate is the size it should have over the size it has. Every document
is repeated a Poisson number of times with its source's rate as mean, found by
inverting the distribution at a number in [0, 1) that a seeded hash of the
document gives; runs repeat exactly. Copies are dealt out by a second hash, which
is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.llm.common import col, free_name, stored

#: A larger mean is drawn as a sum of equal parts of at most this mean each.
LARGEST_MEAN = 16
#: Values of the inverted distribution; a mean of 16 passes 80 with probability below 2^-52, the finest draw.
VALUES = 80


def uniform(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's hash."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. VALUES."""
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(VALUES)), start, step, lambda state: state["sums"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``src, rate, parts, sums`` of every source.

    A document's size is its characters plus one. Targets are the ``weight`` of
    ``weights(source, weight)``, as shares of the present total; sources it does
    not name get none. Without ``weights`` the target share is proportional to
    the square root of the present size, which lifts small sources.
    """
    size = F.coalesce(F.length(col(text_col)), F.lit(0)).cast("bigint") + 1
    sizes = docs.select(F.coalesce(col(source_col), F.lit("")).alias("src"), size.alias("size")).groupBy("src").agg(F.sum("size").alias("size"))
    sizes = stored(sizes, "source-sizes")
    if weights is None:
        wanted = sizes.withColumn("weight", F.sqrt(F.col("size").cast("double")))
    else:
        given = weights.select(F.coalesce("source", F.lit("")).alias("src"), F.col("weight").cast("double").alias("weight"))
        wanted = sizes.join(given.groupBy("src").agg(F.sum("weight").alias("weight")), "src", "left").fillna(0.0, ["weight"])
    total = wanted.agg(F.sum("size").alias("n"), F.sum("weight").alias("w")).first()
    scale = float(total["n"]) / total["w"] if total["w"] else 0.0
    rates = wanted.select("src", (F.col("weight") * F.lit(scale) / F.col("size")).alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    return stored(rates.select("src", "rate", parts.alias("parts")).withColumn("sums", cumulative(F.col("rate") / F.col("parts"))), "source-rates")


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    copy_col: str = "copy",
    order_col: str = "order_key",
) -> DataFrame:
    """Every document as often as drawn, dealt out and sorted by ``order_col``, with the copy's number (from 1).

    Null and empty texts have the size 1. A null source counts as the empty
    string. Rows that share an id share their draw; rows without id draw by their
    texts. An empty table gives an empty result. ``copy_col`` and ``order_col``
    get underscores in front where the input has such columns.
    """
    rates = source_rates(docs, weights, source_col, text_col)
    rates = rates.select(*(F.col(c).alias(free_name(docs, f"mix_{c}")) for c in rates.columns))
    src, _, parts, sums = rates.columns
    copy, order = free_name(docs, copy_col), free_name(docs, order_col)
    nameless = F.concat(F.lit("text:"), F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary")))
    key = F.coalesce(col(id_col).cast("string"), nameless)

    def drawn(total: Column, part: Column) -> Column:
        u = uniform(F.concat_ws(":", key, F.lit(str(seed)), part.cast("string")))
        return total + F.size(F.filter(F.col(sums), lambda p: p <= u))

    # The planner broadcasts the rates if their file is small, and else splits a frequent source's partition.
    joined = docs.join(rates, F.coalesce(col(source_col), F.lit("")) == F.col(src))
    times = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), drawn)
    copies = joined.withColumn(copy, times).drop(*rates.columns).filter(F.col(copy) > 0)
    copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    copies = copies.withColumn(order, F.md5(F.concat_ws(":", key, F.lit(str(seed)), F.lit("copy"), F.col(copy).cast("string"))))
    return copies.repartition(col(order)).sortWithinPartitions(col(order))
