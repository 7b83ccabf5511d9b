"""How sure the metrics of runs are: hash-seeded Poisson bootstrap, paired by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200
METRICS = ("accuracy", "precision", "recall")
#: Draws of 32 bits per digest, of 8 hex digits each.
PER_DIGEST = 4


def poisson_cuts() -> list[int]:
    """At a mean of 1: the numbers below which a draw of 32 bits means at most 0, 1, 2 ... copies."""
    cuts, share, below = [], math.exp(-1.0), 0.0
    for k in range(13):
        below += share
        cuts.append(min(2**32, math.floor(below * 2**32)))
        share /= k + 1
    return cuts


def weights(key: Column, replicates: int, seed: int) -> Column:
    """How often a row counts in each replicate; the same for every run that has the row."""
    copies = F.array(*[F.lit(c).cast("bigint") for c in poisson_cuts()])

    def draw(r: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.floor(r / PER_DIGEST).cast("string")).cast("binary"))
        number = F.conv(F.substr(digest, (r % PER_DIGEST) * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
        return F.size(F.filter(copies, lambda c: c <= number))

    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), draw)


def replicate_counts(detail: DataFrame, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """``replicate, run, tp, tn, fp, fn`` out of ``url, run, predicted, ground_truth`` rows.

    Replicate -1 counts every row once. One aggregate; each task sends one row for each
    run and replicate.
    """
    drawn = F.transform(
        weights(F.col("url"), replicates, seed), lambda w, r: F.struct(r.alias("replicate"), w.alias("w"))
    )
    own = F.array(F.struct(F.lit(-1).alias("replicate"), F.lit(1).alias("w")))
    each = detail.select("run", "predicted", "ground_truth", F.inline(F.concat(own, drawn))).filter("w > 0")

    def cell(predicted: str, truth: str) -> Column:
        mine = (F.col("predicted") == predicted) & (F.col("ground_truth") == truth)
        return F.coalesce(F.sum(F.when(mine, F.col("w").cast("bigint"))), F.lit(0).cast("bigint"))

    return each.groupBy("replicate", "run").agg(
        cell("TRUE", "TRUE").alias("tp"), cell("FALSE", "FALSE").alias("tn"),
        cell("TRUE", "FALSE").alias("fp"), cell("FALSE", "TRUE").alias("fn"),
    )


def _metrics(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    values = {
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in METRICS])
    return counts.select("replicate", "run", F.inline(rows))


def _intervals(values: DataFrame, keys: list[str], level: float) -> DataFrame:
    """The value of replicate -1 and the order statistics of the others that enclose ``level`` of them."""
    sampled = F.array_sort(F.collect_list(F.when(F.col("replicate") >= 0, F.col("value"))))
    found = values.groupBy(*keys).agg(
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("estimate"), sampled.alias("_all")
    )
    n = F.size("_all")
    low = F.floor((1 - level) / 2 * n).cast("int") + 1
    return found.select(
        *keys, "estimate",
        F.try_element_at("_all", low).alias("low"), F.try_element_at("_all", n + 1 - low).alias("high"),
        n.cast("bigint").alias("n_replicates"),
    )


def run_intervals(
    detail: DataFrame, replicates: int = REPLICATES, seed: int = 1, level: float = 0.95
) -> DataFrame:
    """``run, metric, estimate, low, high, n_replicates`` of every run in the detail rows.

    Replicates in which a metric has no denominator are left out of its interval. The
    collected lists hold ``replicates`` numbers.
    """
    return _intervals(_metrics(replicate_counts(detail, replicates, seed)), ["run", "metric"], level)


def paired_difference(
    detail: DataFrame, first: str, second: str, replicates: int = REPLICATES, seed: int = 1, level: float = 0.95
) -> DataFrame:
    """``metric, estimate, low, high, n_replicates, share_above, only_first, only_second`` of second minus first.

    Only rows that both runs labelled count, and a row has the same weight in both.
    ``share_above`` is the share of replicates in which the difference is above zero, ties
    counting half; ``only_first`` and ``only_second`` are the rows that one run alone got right.
    """
    mine = detail.filter(F.col("run").isin(first, second))
    right = F.col("predicted") == F.col("ground_truth")

    def got(run: str) -> Column:
        return F.bool_or(F.when(F.col("run") == run, right))

    both = mine.groupBy("url").agg(got(first).alias("a"), got(second).alias("b")).filter("a is not null and b is not null")
    shared = mine.join(both.select("url"), "url", "left_semi")
    values = _metrics(replicate_counts(shared, replicates, seed)).groupBy("replicate", "metric").agg(
        (F.max(F.when(F.col("run") == second, F.col("value"))) - F.max(F.when(F.col("run") == first, F.col("value")))).alias("value")
    )
    above = F.when(F.col("value") > 0, 1.0).when(F.col("value") == 0, 0.5).when(F.col("value") < 0, 0.0)
    shares = values.filter("replicate >= 0").groupBy("metric").agg((F.sum(above) / F.count(above)).alias("share_above"))
    alone = both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second"))
    counts = alone.first().asDict()
    return _intervals(values, ["metric"], level).join(shares, "metric").withColumns({c: F.lit(n).cast("bigint") for c, n in counts.items()})
