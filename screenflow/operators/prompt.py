"""Few-shot examples, system prompts, chat messages and size estimates.

A prompt that carries examples grows with the train rows, so it is kept as a
table of pieces: sizes are sums over that table, and the text is put together
on the driver only after its size has been checked.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.functions.strings import nonblank, row_text
from screenflow.spec import (
    CHARS_PER_TOKEN,
    EXAMPLES_SLOT,
    RATIONALE_REQUEST,
    TEXT_COLS,
    TOO_LONG,
    USER_TEMPLATE,
    Settings,
    StageSpec,
)

# The layout of the examples block.
EXAMPLES_HEADER = "Examples:\n"
EXAMPLE_GAP = "\n\n"
EXAMPLES_END = "\n"

PIECE_ORDER = ("slot", "part", "ord")
MAX_PROMPT_CHARS = 4_000_000


def user_message(text: Column) -> Column:
    before, after = USER_TEMPLATE.split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


def fewshot_pieces(
    train: DataFrame,
    stage: StageSpec,
    cols: Sequence[str] = TEXT_COLS,
    ord_col: str = "ord",
    label_col: str | None = None,
) -> DataFrame:
    """The examples block as ``(part, ord, piece)``.

    Concatenating the pieces by ``part, ord`` gives the block. Rows without any
    text are left out, and without examples there are no pieces at all.
    """
    label = F.col(label_col or stage.truth_col)
    text = row_text(train.columns, cols)
    example = F.concat(user_message(text), F.lit("\nLabel: "), label)
    if stage.examples_with_rationale and "rationale" in train.columns:
        reason = F.when(
            nonblank(F.col("rationale")), F.concat(F.lit("\nRationale: "), F.col("rationale"))
        )
        example = F.concat(example, F.coalesce(reason, F.lit("")))
    examples = train.filter(text != "").select(
        F.lit(1).alias("part"),
        F.col(ord_col).cast("bigint").alias("ord"),
        F.concat(F.lit(EXAMPLE_GAP), example).alias("piece"),
    )
    frame = F.array(
        F.struct(F.lit(0).alias("part"), F.lit(EXAMPLES_HEADER).alias("piece")),
        F.struct(F.lit(2).alias("part"), F.lit(EXAMPLES_END).alias("piece")),
    )
    ends = (
        train.filter(text != "")
        .limit(1)
        .select(F.inline(frame))
        .select("part", F.lit(None).cast("bigint").alias("ord"), "piece")
    )
    return examples.unionByName(ends)


def prompt_pieces(
    spark: SparkSession,
    template: str,
    block: DataFrame | None = None,
    rationale: bool = False,
) -> DataFrame:
    """A stage's or user's template around the examples, as ``(slot, part, ord, piece)``."""
    segments = template.split(EXAMPLES_SLOT)
    if rationale:
        segments[-1] += RATIONALE_REQUEST
    if block is not None and len(segments) == 1 and not block.isEmpty():
        warnings.warn("template has no examples slot; examples are left out", stacklevel=2)
    pieces = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("slot"),
                        F.lit(3).alias("part"),
                        F.lit(None).cast("bigint").alias("ord"),
                        F.lit(segment).alias("piece"),
                    )
                    for i, segment in enumerate(segments)
                ]
            )
        )
    )
    if block is not None and len(segments) > 1:
        slots = F.explode(F.array(*[F.lit(i) for i in range(1, len(segments))]))
        pieces = pieces.unionByName(block.withColumn("slot", slots))
    return pieces


def prompt_size(pieces: DataFrame) -> DataFrame:
    """Characters and examples of a prompt, without putting it together."""
    return pieces.agg(
        F.coalesce(F.sum(F.length("piece")), F.lit(0)).cast("bigint").alias("n_chars"),
        F.count_if(F.col("part") == 1).alias("n_examples"),
    )


def collect_prompt(pieces: DataFrame, max_chars: int = MAX_PROMPT_CHARS) -> str:
    """The prompt text, once its size is known to be within ``max_chars``."""
    n_chars = prompt_size(pieces).first()["n_chars"]
    if n_chars > max_chars:
        raise ValueError(f"prompt has {n_chars} characters; the limit is {max_chars}")
    return "".join(r["piece"] for r in pieces.orderBy(*PIECE_ORDER).collect())


def build_prompt(
    spark: SparkSession,
    stage: StageSpec,
    settings: Settings,
    train: DataFrame | None = None,
    template: str | None = None,
    max_chars: int = MAX_PROMPT_CHARS,
) -> str:
    """System prompt of a run: own or stage template, train rows, rationale request."""
    block = None if train is None else fewshot_pieces(train, stage, settings.cols)
    pieces = prompt_pieces(spark, template or stage.template, block, settings.rationale)
    return collect_prompt(pieces, max_chars)


def fingerprint(text: str) -> str:
    """Short digest that identifies a prompt in the run log."""
    return hashlib.md5(text.encode()).hexdigest()[:8]


def chat_messages(text: Column, system_prompt: str) -> Column:
    """The two turns of a request."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("system", F.lit(system_prompt)), turn("user", user_message(text)))


def estimated_tokens(text: Column, system_chars: int) -> Column:
    fixed = system_chars + len(USER_TEMPLATE) - len("{text}")
    return F.floor((F.lit(fixed) + F.length(text)) / CHARS_PER_TOKEN).cast("bigint")


def is_oversize(text: Column, system_chars: int, settings: Settings) -> Column:
    """True when the request plus its reply does not fit the context; never without a limit."""
    if settings.context_limit is None:
        return F.lit(False)
    tokens = estimated_tokens(text, system_chars)
    return tokens + F.lit(settings.output_budget()) > F.lit(settings.context_limit)


def oversize_label(text: Column, system_chars: int, settings: Settings) -> Column:
    return F.when(is_oversize(text, system_chars, settings), F.lit(TOO_LONG))


def token_distribution(
    df: DataFrame, text: Column, system_chars: int, limit: int
) -> DataFrame:
    """Size of the requests over all rows.

    Rows collapse to one count per size before the exact percentiles are taken.
    """
    tokens = F.col("tokens")
    sizes = (
        df.select(estimated_tokens(text, system_chars).alias("tokens"))
        .groupBy("tokens")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return sizes.agg(
        F.sum("n").alias("n_rows"),
        F.max(tokens).alias("max_tokens"),
        F.percentile(tokens, 0.5, F.col("n")).alias("p50_tokens"),
        F.percentile(tokens, 0.95, F.col("n")).alias("p95_tokens"),
        F.coalesce(F.sum(F.when(tokens > limit, F.col("n"))), F.lit(0)).alias("over_limit"),
    )
