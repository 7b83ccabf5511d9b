"""Precision, recall and area over all thresholds of ``prob_true``, from a histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1000


def score_histogram(scored: DataFrame, lookup: DataFrame, bins: int = BINS) -> DataFrame:
    """``bin, positives, negatives``: rows of either truth by their probability.

    Bin ``b`` holds probabilities from ``b / bins`` on; 1.0 has a bin of its own. Rows
    without a probability, a truth, or a label (such as skipped ones) take no part.
    Histograms of parts of a table add up with `merge_histograms`.
    """
    usable = F.col("prob_true").between(0.0, 1.0) & F.col("label").isin("TRUE", "FALSE")
    place = F.floor(F.col("prob_true") * bins).cast("int").alias("bin")
    known = scored.filter(usable).join(lookup, "url").filter(F.col("ground_truth").isin("TRUE", "FALSE"))
    return known.groupBy(place).agg(
        F.count_if(F.col("ground_truth") == "TRUE").alias("positives"),
        F.count_if(F.col("ground_truth") == "FALSE").alias("negatives"),
    )


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """One histogram out of those of several parts, with the same bins."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("bin").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives")
    )


def threshold_curve(histogram: DataFrame, bins: int = BINS) -> DataFrame:
    """One row for each threshold that parts the scores, highest first, and the areas.

    At a threshold, rows with at least that probability count as ``TRUE``. Precision and
    recall are null where nothing is counted. ``roc_area`` is the chance that a positive
    row ranks above a negative one, ties within a bin counting half; ``pr_area`` is
    the mean precision at each positive row's bin. The windows run over at most
    ``bins`` + 1 rows.
    """
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    total = histogram.withColumns(
        {
            "tp": F.sum("positives").over(down),
            "fp": F.sum("negatives").over(down),
            "p": F.sum("positives").over(every),
            "n": F.sum("negatives").over(every),
        }
    )
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    # Negatives below a bin's positives, and half of those beside them.
    below = F.col("n") - F.col("fp") + F.col("negatives") / 2.0
    areas = {
        "roc_area": F.try_divide(F.sum(F.col("positives") * below).over(every), F.col("p") * F.col("n")),
        "pr_area": F.try_divide(F.sum(F.col("positives") * precision).over(every), F.col("p")),
    }
    return total.withColumns(areas).select(
        (F.col("bin") / float(bins)).alias("threshold"),
        "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"),
        precision.alias("precision"), F.try_divide(F.col("tp"), F.col("p")).alias("recall"),
        "roc_area", "pr_area",
    )
