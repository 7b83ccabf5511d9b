"""Scorers: anything that turns rows into labels.

`SignalScorer` is made of column expressions. `BatchScorer` is the place for a
model: it calls user code on Arrow batches inside `mapInPandas`, and the replies
are parsed by column expressions afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.replies import parse_reply
from screenflow.functions.strings import row_text
from screenflow.lexicon import MENTAL_HEALTH, Lexicon
from screenflow.operators.prompt import oversize_label
from screenflow.operators.signals import signal_scores
from screenflow.operators.term_join import TermTable, match_terms, score_matches
from screenflow.spec import Settings, StageSpec

PRESET = "preset"
OUTPUT_COLS = ("label", "prob_true", "rationale")

# Called on the texts of one batch; returns a frame with any of the columns
# reply, label, prob_true, rationale, error, one row per text in the same order.
BatchFunction = Callable[[pd.Series], pd.DataFrame]
# Called once per partition with the system prompt, e.g. to open a client.
ScorerFactory = Callable[[str], BatchFunction]


class Scorer(Protocol):
    def label(
        self, rows: DataFrame, stage: StageSpec, settings: Settings, system_prompt: str
    ) -> DataFrame:
        """Replace the text columns by ``label, prob_true, rationale``.

        A non-null ``preset`` label is final and the row is not scored.
        """


def _with_preset(rows: DataFrame) -> DataFrame:
    return rows if PRESET in rows.columns else rows.withColumn(PRESET, F.lit(None).cast("string"))


def _unless_preset(value: Column) -> Column:
    return F.when(F.col(PRESET).isNull(), value)


@dataclass(frozen=True)
class SignalScorer:
    """Deterministic scorer over a lexicon; a row function without Python workers."""

    lexicon: Lexicon = MENTAL_HEALTH
    screen_threshold: float = 1.0
    classify_threshold: float = 2.0
    # A row function may run before rows are reduced to one per key, which
    # keeps the texts out of that shuffle.
    row_function = True

    def threshold(self, stage: StageSpec) -> float:
        return self.screen_threshold if stage.name == "screen" else self.classify_threshold

    def label(
        self, rows: DataFrame, stage: StageSpec, settings: Settings, system_prompt: str = ""
    ) -> DataFrame:
        scored = signal_scores(
            _with_preset(rows), self.lexicon, stage.name, self.threshold(stage), settings.cols
        )
        return scored.withColumns(
            {
                "label": F.coalesce(F.col(PRESET), F.col("label")),
                "prob_true": _unless_preset(F.col("prob_true")),
                "rationale": _unless_preset(F.col("rationale")),
            }
        ).drop(PRESET, "support", "against")


@dataclass(frozen=True)
class TermTableScorer:
    """The rules of `SignalScorer` over a lexicon of any size, met in a join.

    Its join moves matches, not texts. It is no row function: rows should be one per
    key before it, so that copies are not matched twice.
    """

    lexicon: TermTable
    screen_threshold: float = 1.0
    classify_threshold: float = 2.0
    row_function = False

    def label(
        self, rows: DataFrame, stage: StageSpec, settings: Settings, system_prompt: str = ""
    ) -> DataFrame:
        return self.label_stages(rows, [stage], settings).drop("stage")

    def label_stages(self, rows: DataFrame, stages: Sequence[StageSpec], settings: Settings) -> DataFrame:
        """Each row once for each ``stage`` that it names; the texts meet the terms once for all."""
        scored = match_terms(_with_preset(rows), self.lexicon, settings.cols)
        for stage in stages:
            threshold = self.screen_threshold if stage.name == "screen" else self.classify_threshold
            labels = F.struct(
                F.lit(stage.name).alias("stage"),
                F.coalesce(PRESET, "label").alias("label"),
                _unless_preset(F.col("prob_true")).alias("prob_true"),
                _unless_preset(F.col("rationale")).alias("rationale"),
            )
            scored = (
                score_matches(scored, self.lexicon, stage.name, threshold)
                .withColumn(f"_of_{stage.name}", labels)
                .drop("support", "against", "label", "prob_true", "rationale")
            )
        kept = [c for c in rows.columns if c not in settings.cols and c != PRESET]
        return scored.select(*kept, F.inline(F.array(*[f"_of_{s.name}" for s in stages])))


def requests(texts: pd.Series, token_budget: int | None) -> Iterator[pd.Series]:
    """Cut texts, in order, into requests of at most ``token_budget`` estimated tokens.

    A token is taken as four characters. A text beyond the budget is a request of its own.
    """
    if token_budget is None:
        yield texts
        return
    start, used = 0, 0
    for at, tokens in enumerate((texts.str.len() // 4).tolist()):
        if at > start and used + tokens > token_budget:
            yield texts.iloc[start:at]
            start, used = at, 0
        used += tokens
    yield texts.iloc[start:]


def map_texts(
    rows: DataFrame,
    make: ScorerFactory,
    system_prompt: str,
    text_col: str,
    carry: Sequence[str],
    token_budget: int | None = None,
) -> DataFrame:
    """Run a batch function over ``text_col``; rows with a null text are passed by."""
    kept = rows.select(*carry, text_col)
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join(
        [*fields, "reply string", "label string", "prob_true double", "rationale string", "error string"]
    )
    produced = {"reply": "str", "label": "str", "prob_true": "float", "rationale": "str", "error": "str"}
    carried = list(carry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make(system_prompt)
        for batch in batches:
            out = batch[carried].copy()
            wanted = batch[text_col].notna()
            scored = None
            if wanted.any():
                parts = [score(part) for part in requests(batch.loc[wanted, text_col], token_budget)]
                scored = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            for name, kind in produced.items():
                empty = float("nan") if kind == "float" else None
                column = pd.Series(
                    [empty] * len(batch), index=batch.index, dtype="float64" if kind == "float" else "object"
                )
                if scored is not None and name in scored.columns:
                    column.loc[wanted] = scored[name].to_numpy()
                out[name] = column
            yield out

    return kept.mapInPandas(run, schema)


@dataclass(frozen=True)
class BatchScorer:
    """Adapter for a model client.

    ``make`` must be picklable. ``partitions`` bounds how many clients run at a
    time and spreads the rows evenly over them. With ``token_budget``, the texts of a
    partition are handed over in requests of at most as many estimated tokens. A row
    whose call failed has an ``error`` and no label; it is stored as an attempt and
    retried by the next run, up to ``Settings.max_tries``.
    """

    make: ScorerFactory
    partitions: int | None = None
    token_budget: int | None = None
    row_function = False

    def label(
        self, rows: DataFrame, stage: StageSpec, settings: Settings, system_prompt: str
    ) -> DataFrame:
        text = row_text(rows.columns, settings.cols)
        carry = [c for c in rows.columns if c not in settings.cols and c != PRESET]
        routed = (
            _with_preset(rows)
            .withColumn(
                PRESET, F.coalesce(PRESET, oversize_label(text, len(system_prompt), settings))
            )
            .withColumn("_text", _unless_preset(text))
        )
        if self.partitions:
            spread = ["url"] if "url" in rows.columns else []
            routed = routed.repartition(self.partitions, *spread)
        scored = map_texts(routed, self.make, system_prompt, "_text", [*carry, PRESET], self.token_budget)
        parsed = parse_reply(F.col("reply"), settings.label_set(), settings.rationale)
        return (
            scored.withColumn("_parsed", F.when(F.col("reply").isNotNull(), parsed))
            .select(
                *carry,
                F.when(
                    F.col("error").isNull(), F.coalesce(PRESET, "label", "_parsed.label")
                ).alias("label"),
                F.nanvl("prob_true", F.lit(None).cast("double")).alias("prob_true"),
                F.coalesce("rationale", "_parsed.rationale").alias("rationale"),
                "error",
            )
        )
