"""Curves, intervals and agreement against plain counting."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from screenflow.operators.bootstrap import paired_difference, poisson_cuts, run_intervals, weights
from screenflow.operators.compare import agreement_alpha, coincidences
from screenflow.operators.curves import merge_histograms, score_histogram, threshold_curve

DETAIL = "url string, run string, predicted string, ground_truth string"


def test_curve_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f"u{i}", rng.choice(["TRUE", "FALSE"]), round(rng.random() ** 2, 1)) for i in range(200)]
    rows += [("u1", "TRUE", None), ("u2", "SKIPPED", 0.5), ("none", "TRUE", 0.5), ("u3", "TRUE", float("nan")), ("u4", "TRUE", 1.0)]
    truth = [(f"u{i}", rng.choice(["TRUE", "FALSE", "FALSE"])) for i in range(200)]
    scored = spark.createDataFrame(rows, "url string, label string, prob_true double")
    lookup = spark.createDataFrame(truth, "url string, ground_truth string")
    parts = [score_histogram(scored.filter(F.crc32("url") % 3 == k), lookup, 10) for k in range(3)]
    got = threshold_curve(merge_histograms(*parts), 10).collect()
    known = dict(truth)
    used = [(math.floor(p * 10), known[u] == "TRUE") for u, x, p in rows if u in known and x != "SKIPPED" and p is not None and p == p]
    pairs = [(a > b) + (a == b) / 2 for (a, x), (b, y) in itertools.product(used, used) if x and not y]
    for r in got:
        cut = round(r["threshold"] * 10)
        tp = sum(y for b, y in used if b >= cut)
        fp = sum(not y for b, y in used if b >= cut)
        assert (r["tp"], r["fp"], r["tp"] + r["fn"]) == (tp, fp, sum(y for _, y in used))
        assert r["precision"] == pytest.approx(tp / (tp + fp))
        assert r["roc_area"] == pytest.approx(sum(pairs) / len(pairs))
    assert {round(r["threshold"] * 10) for r in got} == {b for b, _ in used}
    assert threshold_curve(score_histogram(scored.limit(0), lookup)).count() == 0
    one_sided = threshold_curve(score_histogram(scored, lookup.withColumn("ground_truth", F.lit("TRUE")), 10), 10)
    assert {r["roc_area"] for r in one_sided.collect()} == {None}


def test_weights_are_poisson_and_the_same_for_every_run(spark):
    n = 4000
    drawn = spark.range(n).select(weights(F.col("id").cast("string"), 40, 3).alias("w"))
    counts = {r["w"]: r["n"] for r in drawn.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    for k in range(5):
        assert counts[k] / (40 * n) == pytest.approx(math.exp(-1) / math.factorial(k), rel=0.08)
    assert poisson_cuts() == sorted(poisson_cuts()) and poisson_cuts()[0] == math.floor(math.exp(-1) * 2**32)


def test_intervals_and_paired_differences(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        truth = rng.choice(["TRUE", "FALSE"])
        for run, right in (("a", 0.7), ("b", 0.9)):
            other = "FALSE" if truth == "TRUE" else "TRUE"
            rows.append((f"u{i}", run, truth if rng.random() < right else other, truth))
    detail = spark.createDataFrame([*rows, ("only-a", "a", "TRUE", "FALSE")], DETAIL)
    got = {(r["run"], r["metric"]): r for r in run_intervals(detail, 200, seed=5).collect()}
    for run in ("a", "b"):
        mine = [r for r in [*rows, ("only-a", "a", "TRUE", "FALSE")] if r[1] == run]
        accuracy = sum(p == t for _, _, p, t in mine) / len(mine)
        r = got[run, "accuracy"]
        assert r["estimate"] == pytest.approx(accuracy) and r["low"] < accuracy < r["high"]
        error = math.sqrt(accuracy * (1 - accuracy) / len(mine))
        assert 0.7 * 3.92 * error < r["high"] - r["low"] < 1.3 * 3.92 * error
    again = {(r["run"], r["metric"]): r for r in run_intervals(detail.repartition(7), 200, seed=5).collect()}
    assert again == got
    apart = {r["metric"]: r for r in paired_difference(detail, "a", "b", 200, seed=5).collect()}
    by = {(u, run): p == t for u, run, p, t in rows}
    assert apart["accuracy"]["only_first"] == sum(by[f"u{i}", "a"] and not by[f"u{i}", "b"] for i in range(400))
    assert apart["accuracy"]["only_second"] == sum(by[f"u{i}", "b"] and not by[f"u{i}", "a"] for i in range(400))
    assert apart["accuracy"]["low"] > 0 and apart["accuracy"]["share_above"] == 1.0
    alike = detail.filter("run = 'a'")
    same = paired_difference(alike.union(alike.withColumn("run", F.lit("b"))), "a", "b", 50).collect()
    assert {(r["estimate"], r["low"], r["high"], r["share_above"]) for r in same} == {(0.0, 0.0, 0.0, 0.5)}


def test_alpha_of_a_worked_example(spark):
    """Four raters, twelve units, missing values: the coincidences are counted once more in plain Python."""
    table = ["1233212341.. ".strip(), "12332241251 ".strip() + ".", ".33323422513", "12332445.1.."]
    rows = [(f"u{i}", str(c)) for line in table for i, c in enumerate(line.ljust(12, ".")) if c != "."]
    rows += [("alone", "1"), ("skip", "SKIPPED"), ("skip", "2"), ("null", None)]
    labels = ["1", "2", "3", "4", "5"]
    results = spark.createDataFrame(rows, "url string, label string")
    units = {}
    for u, x in rows:
        if x in labels:
            units.setdefault(u, []).append(x)
    want = {}
    for values in units.values():
        for i, j in itertools.permutations(range(len(values)), 2):
            pair = (values[i], values[j])
            want[pair] = want.get(pair, 0) + 1 / (len(values) - 1)
    got = {(r["first"], r["second"]): r["weight"] for r in coincidences(results, labels).collect() if r["weight"]}
    assert got == pytest.approx(want)
    n = sum(want.values())
    sizes = {c: sum(w for (a, _), w in want.items() if a == c) for c in labels}
    observed = sum(w for (a, b), w in want.items() if a != b) / n
    expected = sum(sizes[a] * sizes[b] for a in labels for b in labels if a != b) / (n * (n - 1))
    r = agreement_alpha(results, labels).first()
    assert (r["n_values"], r["observed"], r["expected"], r["alpha"]) == pytest.approx((n, observed, expected, 1 - observed / expected))
    same = agreement_alpha(results.withColumn("label", F.lit("TRUE"))).first()
    assert same["alpha"] is None and same["observed"] == 0.0
    assert agreement_alpha(results.limit(0)).first()["alpha"] is None
