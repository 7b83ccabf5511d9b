"""Centroid clustering with n-simplex projection.

The distances of a vector to the pivots (the initial centroids) are measured once and
kept as the apex of a simplex over the pivots: coordinates in the pivots' span and an
altitude above it. Between two apexes, the distance with both altitudes on one side is
a lower bound of the true distance, and with altitudes on opposite sides an upper one.
A centroid whose lower bound exceeds another's upper bound can't be the nearest; those
left are compared by exact integer distance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.llm.common import binary_column, col, free_name, stored

#: Components up to this size are compared in 64-bit integers, larger ones in Python's.
PLAIN = 1 << 24
#: A pivot nearer than this share to the span of those before it is left out.
FLAT = 0.05
#: Share of the squared distances that a bound may be off through rounding.
SLACK = 1e-6
#: Sums travel in limbs of this many bits, so that they are exact at any size.
LIMB = 40
LONG = (1 << 63) - 1


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 or, if one is large, as Python integers."""
    if len(values) and np.abs(values).max() * scale >= PLAIN:
        # A double of 2^52 and more is an integer.
        large = [math.floor(scale * x) if abs(x) < 2.0**52 else scale * int(x) for x in values.ravel().tolist()]
        return np.array(large, object).reshape(values.shape)
    return np.floor(scale * values).astype(np.int64)


def squared(a: np.ndarray, b) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the vector ``b``."""
    b = np.array(b, object)
    if a.dtype != object and max(map(abs, b.tolist()), default=0) < PLAIN:
        apart = a - b.astype(np.int64)
        return np.einsum("ij,ij->i", apart, apart)
    apart = a.astype(object) - b
    return (apart * apart).sum(axis=1)


def as_doubles(numbers: np.ndarray) -> np.ndarray:
    """Exact numbers as doubles, infinite beyond their range."""
    if numbers.dtype != object:
        return numbers.astype(float)
    return np.array([float(x) if x < 10**300 else math.inf for x in numbers], float)


class Simplex:
    """The simplex over those pivots that are not in the span of the ones before."""

    def __init__(self, pivots: list[list[int]]):
        self.pivots, self.base = pivots[:1], np.zeros((0, 0))
        for pivot in pivots[1:]:
            y, height = self.apexes(np.array([pivot], object))
            size = math.sqrt(float((y * y).sum()) + float(height[0]) ** 2)
            if math.isfinite(size) and height[0] > FLAT * size:
                n = len(self.base)
                grown = np.zeros((n + 1, n + 1))
                grown[:n, :n], grown[n, :n], grown[n, n] = self.base, y[0], height[0]
                self.pivots, self.base = [*self.pivots, pivot], grown

    def apexes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the span of the pivots, and the altitudes above it."""
        far = np.array([as_doubles(squared(vectors, p)) for p in self.pivots])
        sizes = (self.base * self.base).sum(axis=1)
        y = np.zeros((len(vectors), len(self.base)))
        for k in range(len(self.base)):
            with np.errstate(all="ignore"):
                y[:, k] = ((far[0] + sizes[k] - far[k + 1]) / 2 - y[:, :k] @ self.base[k, :k]) / self.base[k, k]
        with np.errstate(all="ignore"):
            return y, np.sqrt(np.maximum(far[0] - (y * y).sum(axis=1), 0))


def candidates(y: np.ndarray, height: np.ndarray, centre_y: np.ndarray, centre_height: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest, by the bounds alone. What can't be computed stays."""
    with np.errstate(all="ignore"):
        own, theirs = (y * y).sum(axis=1) + height**2, (centre_y * centre_y).sum(axis=1) + centre_height**2
        middle = own[:, None] + theirs[None, :] - 2 * y @ centre_y.T
        turn = 2 * height[:, None] * centre_height[None, :]
        slack = SLACK * (own[:, None] + theirs.max())
        return ~(middle - turn > (middle + turn).min(axis=1)[:, None] + slack)


def nearest(vectors: np.ndarray, y: np.ndarray, height: np.ndarray, simplex: Simplex, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of each vector's nearest centroid, ties to the smaller."""
    can = candidates(y, height, *simplex.apexes(np.array(centroids, object)))
    best, at = np.full(len(vectors), None, object), np.zeros(len(vectors), np.int64)
    if vectors.dtype != object and all(abs(x) < PLAIN for c in centroids for x in c):
        best = np.full(len(vectors), LONG, np.int64)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(can[:, number])
        if not len(rows):
            continue
        far = squared(vectors[rows], centroid)
        less = far < best[rows] if best.dtype != object else np.array([b is None or f < b for f, b in zip(far, best[rows], strict=True)], bool)
        best[rows[less]], at[rows[less]] = far[less], number
    return at, best


def unpacked(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    data, _ = binary_column(batch.column(name))
    return np.frombuffer(data.tobytes(), np.float64).reshape(-1, width)


def projected(simplex: Simplex, dims: int, scale: int):
    """Packs each vector and its apex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            y, height = simplex.apexes(whole_numbers(flat, scale))
            apex = np.column_stack([y, height])
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (flat, apex)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *packed], ["vec_id", "body", "apex"])

    return run


def assigned(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: list[list[int]], scale: int):
    width, dims = len(simplex.base) + 1, len(centroids[0])
    for batch in batches:
        vectors, apex = whole_numbers(unpacked(batch, "body", dims), scale), unpacked(batch, "apex", width)
        yield batch, vectors, *nearest(vectors, apex[:, :-1], apex[:, -1], simplex, centroids)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as a sum of signed limbs, each with its place."""
    place = 0
    while value:
        value, low = (0, value) if abs(value) < 1 << LIMB else divmod(value, 1 << LIMB)
        yield place, low
        place += 1


def cluster_sums(simplex: Simplex, centroids: list[list[int]], scale: int):
    """Count and component sums of every cluster, one set of rows for each task; position -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), len(centroids[0]) + 1), object)
        for _, vectors, at, _ in assigned(batches, simplex, centroids, scale):
            for number in np.unique(at).tolist():
                rows = vectors[at == number]
                sums[number, 0] += len(rows)
                sums[number, 1:] += rows.sum(axis=0).astype(object)
        found = [(c, p - 1, place, low) for (c, p), total in np.ndenumerate(sums) for place, low in limbs(int(total))]
        columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "position", "place", "total"])

    return run


def moved(centroids: list[list[int]], sums: DataFrame) -> list[list[int]]:
    """The centroids after one round. The collected rows are bounded by centroids x components x limbs of a double."""
    totals: dict[tuple[int, int], int] = {}
    for r in sums.groupBy("cluster", "position", "place").agg(F.sum("total").alias("total")).collect():
        at = (r["cluster"], r["position"])
        totals[at] = totals.get(at, 0) + (r["total"] << (LIMB * r["place"]))
    out = []
    for number, centroid in enumerate(centroids):
        n = totals.get((number, -1), 0)
        out.append([totals.get((number, i), 0) // n for i in range(len(centroid))] if n else centroid)
    return out


def final_rows(simplex: Simplex, centroids: list[list[int]], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at, far in assigned(batches, simplex, centroids, scale):
            fits = [x if x <= LONG else None for x in far.tolist()]
            columns = [batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def usable(vector: Column, dims: int) -> Column:
    """Vectors of ``dims`` components, none null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every usable vector.

    Components become floor(scale * x). The first centroids are the ``k`` vectors with
    the smallest SHA-256 of ``seed:id``. Vectors of another length, null, or with a component that
    is null or not finite take no part. Rows that repeat an id are vectors of their own;
    equal hashes are ordered by their vectors. A null id hashes as the empty text. With
    fewer than ``k`` vectors there are as many centroids; an empty table gives an empty
    result. Any double is compared and summed exactly; a distance or sum beyond a long
    is null. Other columns are not looked at.
    """
    name = free_name(vectors, "as_double")
    doubles = vectors.withColumn(name, col(vector_col).cast("array<double>")).filter(usable(F.col(name), dims))
    doubles = doubles.select(col(id_col).cast("bigint").alias("vec_id"), F.col(name).alias("vector"))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = doubles.orderBy(start, "vector").limit(k).collect()
    if not first:
        shape = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], shape)
    centroids = [[int(x) for x in row] for row in whole_numbers(np.array([r["vector"] for r in first]), scale).tolist()]
    simplex = Simplex(centroids)
    ready = stored(doubles.mapInArrow(projected(simplex, dims, scale), "vec_id bigint, body binary, apex binary"), "apexes")
    for _ in range(rounds):
        sums = ready.mapInArrow(cluster_sums(simplex, centroids, scale), "cluster bigint, position bigint, place bigint, total bigint")
        centroids = moved(centroids, sums)
    found = stored(ready.mapInArrow(final_rows(simplex, centroids, scale), "vec_id bigint, cluster int, distance bigint"), "clusters")
    # One row for each cluster reaches the driver, at most ``k``.
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"), F.count(F.when(F.col("distance").isNull(), 1)).alias("beyond"))
    parts = {r["cluster"]: None if r["beyond"] else int(r["part"]) for r in each.collect()}
    whole = None if None in parts.values() else sum(parts.values())
    fits = lambda x: x if x is not None and x <= LONG else None
    sizes = [(c, fits(part), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, part in parts.items()]
    sizes = vectors.sparkSession.createDataFrame(sizes, "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.join(F.broadcast(sizes), F.col("cluster") == F.col("number"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
