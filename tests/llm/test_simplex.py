"""Clusters against plain integers, and what the simplex bounds promise."""

from __future__ import annotations

import numpy as np
import pytest

from screenflow.llm.queries import op12_simplex_clusters
from screenflow.llm.simplex import Simplex, candidates, cluster_vectors, limbs, squared
from tests.llm import brute


def rows(df):
    return ordered(tuple(r) for r in df.collect())


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


def test_query_on_the_given_table(spark, data):
    table = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows(op12_simplex_clusters(spark, data)) == ordered(brute.op12(table))


@pytest.mark.parametrize("size", [1.0, 1e7, 1e40, 1e306])
def test_nulls_repeats_ties_and_large_components(spark, size):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 5).round(2) * size]) for i in range(60)]
    vectors += [(60, None), (61, [None] * 5), (62, [float("nan")] * 5), (63, [float("inf")] * 5), (64, [1.0] * 4), (65, [])]
    vectors += [(7, vectors[7][1]), (8, vectors[9][1]), (70, vectors[11][1]), (None, [0.5] * 5), (71, [0.0] * 5), (72, [-0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id bigint, embedding array<double>, as_double int, cluster int")
    want = ordered(brute.op12(vectors, dims=5, k=6))
    assert rows(cluster_vectors(df.repartition(5), dims=5, k=6)) == want
    assert (size > 1e9) == any(r[2] is None for r in want)


def test_fewer_vectors_than_centroids_and_none(spark):
    vectors = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    assert rows(cluster_vectors(df, dims=2)) == ordered(brute.op12(vectors, dims=2))
    empty = cluster_vectors(df.limit(0), dims=2)
    assert empty.count() == 0 and empty.columns == cluster_vectors(df, dims=2).columns


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(6)
    centres = rng.integers(-40, 40, (16, 64))
    vectors = centres[rng.integers(0, 16, 500)] + rng.integers(-6, 6, (500, 64))
    simplex = Simplex(centres.tolist())
    can = candidates(*simplex.apexes(vectors), *simplex.apexes(centres + rng.integers(-2, 2, centres.shape)))
    true = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert can[np.arange(500), true.argmin(axis=1)].all()
    assert can.mean() < 0.2, "few centroids are left to compare"


def test_pivots_in_the_span_of_others_are_left_out():
    simplex = Simplex([[0, 0, 0], [4, 0, 0], [8, 0, 0], [4, 0, 0], [0, 3, 0]])
    assert simplex.pivots == [[0, 0, 0], [4, 0, 0], [0, 3, 0]]
    y, height = simplex.apexes(np.array([[1, 2, 5]]))
    assert np.allclose(y, [[1, 2]]) and np.allclose(height, [5])


def test_limbs_and_distances_are_exact():
    for value in (0, 1, -1, 2**40, -(2**40) - 3, 3**200, -(3**200)):
        assert sum(low << (40 * place) for place, low in limbs(value)) == value
    assert squared(np.array([[10**200, 1]], object), [0, 0]).tolist() == [10**400 + 1]
