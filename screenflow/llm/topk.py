"""Exact top-k search on a bit-sliced index.

The index holds, for each block of rows and each dimension, one bitmap for every
bit of the quantised component. A query's inner products with all rows of a block
come out of bitmap arithmetic: the slices, weighted by the bits of the query's
component, are added by carry-save adders into slices of the score. The top rows
are then selected from the most significant slice downward; rows that are still
tied after the last slice have equal scores and are resolved by the smaller id.

Index blocks move once and blocks of queries, which are far smaller, are sent to each of
them; while there are fewer index blocks than tasks, each block is sent to several tasks with a
share of the queries. A block sends on its k best rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from screenflow.llm.common import col, stored

#: Components become floor(SCALE * x).
SCALE = 256
#: Rows in an index block, queries in a query block.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 128
#: Quantised components must be smaller than this, so that scores fit.
LARGEST = 1 << 24
INDEX = "block int, dims int, n int, bits int, base bigint, ids binary, slices binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: usable rows, one for each id and quantised vector."""
    values = F.transform(col(vector_col), lambda x: x.cast("double"))
    usable = F.forall(col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(col(id_col).isNotNull() & col(vector_col).isNotNull()).filter(usable)
    too_large = F.exists(values, lambda x: F.abs(x) >= LARGEST / SCALE)
    checked = F.when(too_large, F.raise_error(F.lit(f"components must be below {LARGEST // SCALE}"))).otherwise(
        F.transform(values, lambda x: F.floor(x * SCALE).cast("int"))
    )
    return rows.select(col(id_col).cast("bigint").alias("id"), checked.alias("v")).distinct()


def build_block(table: pa.Table) -> pa.Table:
    """One index row for each vector length in the block."""
    block = table.column("block")[0].as_py()
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = {name.split()[0]: [] for name in INDEX.split(", ")}
    starts = lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy()
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        rows = rows[np.argsort(ids[rows])]
        matrix = flat[starts[rows][:, None] + np.arange(dims)].astype(np.int64) if dims else np.zeros((len(rows), 0), np.int64)
        base = int(matrix.min()) if matrix.size else 0
        bits = max(1, int(matrix.max() - base).bit_length()) if matrix.size else 1
        shifted = (matrix - base).T
        slices = np.stack([bitmap((shifted >> b) & 1) for b in range(bits)], axis=1) if dims else np.zeros((0, bits, 0), np.uint64)
        for name, value in zip(out, (block, int(dims), len(rows), bits, base, ids[rows].astype(np.int64).tobytes(), slices.tobytes()), strict=True):
            out[name].append(value)
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words, the first flag in the lowest bit."""
    packed = np.packbits(flags.astype(np.uint8), axis=-1, bitorder="little")
    width = -(-flags.shape[-1] // 64) * 8
    full = np.zeros((*packed.shape[:-1], width), np.uint8)
    full[..., : packed.shape[-1]] = packed
    return full.view(np.uint64)


def add_up(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of all bitmaps, given by weight (a power of two), as one slice for each weight.

    Carry-save adders take three bitmaps of a weight to one of that weight and
    one of the next, many at a time.
    """
    out = []
    weight = 0
    while weight <= max(columns, default=-1):
        parts = columns.get(weight, [])
        stack = np.concatenate(parts) if parts else None
        if stack is None:
            out.append(None)
        else:
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    stack = np.concatenate([half ^ c, stack[3 * third :]])
                else:
                    carry = stack[:1] & stack[1:]
                    stack = stack[:1] ^ stack[1:]
                columns.setdefault(weight + 1, []).append(carry)
            out.append(stack[0])
        weight += 1
    return out


def scores(slices: np.ndarray, base: int, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the scores of all rows, and the number to add to them.

    A negative component takes the complement of its slices: -q u = q (top - u) - q top.
    """
    dims, bits, _ = slices.shape
    columns: dict[int, list[np.ndarray]] = {}
    size = np.abs(query)
    for b in range(int(size.max()).bit_length() if dims else 0):
        for sign in (1, -1):
            use = ((size >> b) & 1 == 1) & (query * sign > 0)
            if use.any():
                for k in range(bits):
                    columns.setdefault(b + k, []).append(slices[use, k] if sign > 0 else ~slices[use, k])
    top = (1 << bits) - 1
    return add_up(columns), int(query.sum()) * base - int(size[query < 0].sum()) * top


def select_top(score: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows with the largest scores, ties to the smaller position."""
    sure, open_ = np.zeros_like(live), live.copy()
    n_sure = 0
    for slice_ in reversed(score):
        if slice_ is None:
            continue
        ones = open_ & slice_
        n = int(np.bitwise_count(ones).sum())
        if n_sure + n > k:
            open_ = ones
        else:
            sure |= ones
            n_sure += n
            open_ &= ~slice_
            if n_sure == k:
                open_[:] = 0
                break
    tied = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - n_sure]
    return np.concatenate([np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")), tied])


def search(k: int):
    """The k best rows of an index block for every query of a query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                words = -(-row["n"] // 64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["bits"], words)
                every = bitmap(np.ones((1, row["n"]), np.uint8))[0]
                out = ([], [], [])
                for query_id, vector in zip(row["query_ids"], row["queries"], strict=True):
                    query = np.array(vector, np.int64)
                    live = every.copy()
                    for own in range(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")):
                        live[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
                    score, shift = scores(slices, row["base"], query)
                    at = select_top(score, live, k)
                    value = np.full(len(at), shift, np.int64)
                    for weight, slice_ in enumerate(score):
                        if slice_ is not None:
                            value += ((slice_[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
                    out[0].append(np.full(len(at), query_id, np.int64))
                    out[1].append(ids[at])
                    out[2].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest inner products, ties to the smaller id.

    Every row of ``vectors`` but the query's own is a candidate: rows of one id with
    different vectors each are, equal ones count once, and a query that repeats an id
    asks with its least vector. Null ids and vectors that are null or hold null or
    non-finite components take no part. Vectors meet queries of
    their own length only. Components of 65,536 or more are an error. Empty
    tables give an empty result; other columns are not looked at.
    """
    rows = stored(quantised(vectors, id_col, vector_col), "quantised")
    asked = stored(quantised(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n_blocks = -(-rows.count() // BLOCK_ROWS) or 1
    n_asked = -(-asked.count() // BLOCK_QUERIES) or 1
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    index = stored(placed.groupBy("block").applyInArrow(build_block, INDEX), "index")
    part = F.pmod(F.xxhash64("id"), F.lit(n_asked)).cast("int")
    blocks = asked.groupBy(part.alias("part"), F.size("v").alias("dims")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    blocks = blocks.select("part", "dims", F.col("q.id").alias("query_ids"), F.col("q.v").alias("queries"))
    # A lane is a task's share of the queries; there is one if the index has blocks enough for all tasks.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_lanes = min(n_asked, -(-tasks // n_blocks))
    sent = blocks.withColumn("lane", F.col("part") % n_lanes).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    lanes = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))))
    # Repartitioned by number, as tasks that are large by work and small by bytes must not be put together.
    keys = ["block", "lane", "dims"]
    lanes, sent = (x.repartition(n_blocks * n_lanes, *keys) for x in (lanes, sent))
    work = lanes.hint("merge").join(sent, keys)
    best = work.drop("part", "block", "lane").mapInArrow(search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
