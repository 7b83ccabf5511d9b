"""Instruction-style benchmark records to posts, labels and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenflow.functions.strings import strip
from screenflow.spec import BENCHMARK_KEY_PREFIX

# The patterns of the benchmark's instruction and reply texts.
QUOTED_POST = r"""(?sU)Consider this post:\s*["'](.+?)["'](?:\s+Question:|\s*$)"""
PLAIN_POST = r"(?sU)Consider this post:\s*(.+?)\s*Question:"
REASONING = r"(?sU)[Rr]easoning:\s*(.+)"


def extract_post(query: Column) -> Column:
    """The quoted post, else the unquoted one, else the whole text; stripped."""
    query = F.coalesce(query, F.lit(""))

    def found(pattern: str) -> Column:
        # Both patterns need at least one character, so '' means "no match".
        return F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))

    return strip(F.coalesce(found(QUOTED_POST), found(PLAIN_POST), query))


def extract_label(response: Column) -> Column:
    """``TRUE`` for a reply that starts with yes, ``FALSE`` for no, else null."""
    start = F.lower(F.substring(strip(response), 1, 3))
    return F.when(start == "yes", F.lit("TRUE")).when(F.startswith(start, F.lit("no")), F.lit("FALSE"))


def extract_reasoning(response: Column) -> Column:
    """Text after the first ``Reasoning:``; empty if there is none or no label."""
    found = strip(F.regexp_extract(strip(response), REASONING, 1))
    return F.when(extract_label(response).isNotNull(), found).otherwise(F.lit(""))


def source_key(task: Column, idx: Column, post: Column) -> Column:
    """Synthetic row key: prefix, task, source index and a short digest of the post."""
    return F.concat_ws(
        ":",
        F.lit(BENCHMARK_KEY_PREFIX),
        task,
        idx.cast("string"),
        F.substring(F.md5(post), 1, 8),
    )
