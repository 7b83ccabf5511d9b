"""Length buckets with least padding, and token-budget batches.

A dynamic programme over the global length histogram chooses the bucket
boundaries for which padding every sequence to its bucket's boundary adds the
fewest tokens. Documents longer than the context are cut into pieces of it, so
the histogram has at most as many rows as the context has tokens, whatever the
size of the input. Inside a bucket, sequences are dealt in turn to as many batches
as the token budget asks for, so copies of a document land in different ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from screenflow.llm.common import WORD, col

#: Sequences that are ranked together; each such shard rounds its number of batches up.
SHARD_ROWS = 8192
#: One word with the white space after it (and, at the start, before it): pieces joined give the text.
TOKEN = r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending upper lengths of at most ``buckets`` buckets with the least padding in total.

    Only lengths that occur can be boundaries. ``cost(i, j)``, padding lengths
    i+1 .. j to the j-th, comes from sums of counts and tokens, so each step of
    the programme is one pass over all starts.
    """
    order = np.argsort(lengths)
    size, n = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    m = len(size)
    buckets = min(buckets, m)
    best = np.full(m + 1, np.iinfo(np.int64).max // 2)
    best[0] = 0
    froms = []
    for _ in range(buckets):
        new, came = best.copy(), np.full(m + 1, -1)
        new[0] = 0
        for j in range(1, m + 1):
            total = best[:j] + (rows[j] - rows[:j]) * size[j - 1] - (tokens[j] - tokens[:j])
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], came[j] = total[i], i
        best = new
        froms.append(came)
    out, j = [], m
    for came in reversed(froms):
        if j and came[j] >= 0:
            out.append(int(size[j - 1]))
            j = int(came[j])
    return out[::-1]


def pieces(text: Column, n_words: Column, context: int) -> Column:
    """The text in pieces of at most ``context`` words; joined they give the text. Without words: none."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    part = lambda k: F.struct(
        k.alias("piece"),
        F.least(F.lit(context), n_words - k * context).cast("int").alias("n_tokens"),
        F.array_join(F.slice(tokens, k * context + 1, context), "").alias("text"),
    )
    whole = F.array(F.struct(F.lit(0).alias("piece"), n_words.cast("int").alias("n_tokens"), text.alias("text")))
    many = F.transform(F.sequence(F.lit(0), F.floor((n_words - 1) / context).cast("int")), part)
    return F.when(n_words == 0, F.array().cast("array<struct<piece:int,n_tokens:int,text:string>>")).when(n_words <= context, whole).otherwise(many)


def pack(
    docs: DataFrame, context: int = 2048, buckets: int = 8, budget: int = 65536, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, n_tokens, bucket, shard, batch, slot, text``: one row for each piece.

    A token is a word. ``bucket`` is the boundary that the piece is padded to;
    (bucket, shard, batch) names a batch of at most ``budget`` padded tokens
    (one sequence at least). Texts are cut, never shortened. Null, empty and
    blank texts have no tokens and no row. Repeated rows are packed once each, and
    which of their batches each goes to follows the table's split into tasks; a
    null id stays null. An empty table gives an empty result; other columns are
    not looked at.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), text.alias("body"), F.regexp_count(text, F.lit(WORD)).alias("n"))
    lengths = F.array_compact(F.array(
        F.when(F.col("n") >= context, F.struct(F.lit(context).alias("size"), F.floor(F.col("n") / context).alias("times"))),
        F.when(F.col("n") % context > 0, F.struct((F.col("n") % context).alias("size"), F.lit(1).cast("bigint").alias("times"))),
    ))
    histogram = rows.select(F.inline(lengths)).groupBy("size").agg(F.sum("times").alias("times")).collect()
    bounds = best_boundaries([r["size"] for r in histogram], [r["times"] for r in histogram], buckets) if histogram else [context]
    sizes = {b: 0 for b in bounds}
    for r in histogram:
        sizes[min(b for b in bounds if b >= r["size"])] += r["times"]
    table = F.create_map(*(F.lit(x) for b, n in sizes.items() for x in (b, -(-n // SHARD_ROWS) or 1)))
    cut = rows.select("doc_id", F.inline(pieces(F.col("body"), F.col("n"), context)))
    bucket = F.element_at(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b >= F.col("n_tokens")), 1)
    # The place in its task tells equal rows apart, so that they don't share a shard.
    spread = F.xxhash64("doc_id", "piece", "text", F.monotonically_increasing_id())
    placed = cut.withColumn("bucket", bucket).withColumn("spread", spread)
    placed = placed.withColumn("shard", F.pmod("spread", table[F.col("bucket")]).cast("int"))
    group = Window.partitionBy("bucket", "shard")
    fits = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    batches = F.ceil(F.count("*").over(group) / fits)
    rank = F.row_number().over(group.orderBy("spread", "doc_id", "piece")) - 1
    return placed.withColumn("rank", rank).withColumn("batches", batches).select(
        "doc_id", "piece", "n_tokens", "bucket", "shard",
        (F.col("rank") % F.col("batches")).alias("batch"), F.floor(F.col("rank") / F.col("batches")).cast("int").alias("slot"), "text",
    )
