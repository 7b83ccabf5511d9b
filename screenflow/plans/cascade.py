"""Both stages of the signal scorer in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.lexicon import Lexicon
from screenflow.operators.rows import is_failed
from screenflow.operators.score import SignalScorer
from screenflow.operators.signals import find_terms, score_terms
from screenflow.spec import CLASSIFY, SCREEN, SKIPPED, TEXT_COLS, Settings

Model = tuple[Settings, SignalScorer]


def signal_cascade(
    videos: DataFrame, models: Sequence[Model], cols: Sequence[str] = TEXT_COLS
) -> DataFrame:
    """Wide labels of both stages and all models for every row.

    The gate between the stages looks at a column of the same row, so with a
    row function no join and no shuffle is needed: one scan cuts the texts once
    and every rule reads the terms found. Failed rows are ``SKIPPED`` in both
    stages; rows that the screen rejects stay null in the second. Compound hashtags
    are cut by the words of all models together.
    """
    everything = Lexicon(
        tuple(s for _, scorer in models for s in scorer.lexicon.signals),
        next((x.lexicon.hashtag_signal for _, x in models if x.lexicon.hashtag_signal), None),
        tuple(dict.fromkeys(w for _, x in models for w in x.lexicon.tag_words)),
    )
    failed = is_failed(videos)
    rows = find_terms(videos, everything, cols)
    skipped = F.when(failed, F.lit(SKIPPED))
    results: list[Column] = []
    for i, (settings, scorer) in enumerate(models):
        for stage in (SCREEN, CLASSIFY):
            rows = score_terms(rows, scorer.lexicon, stage.name, scorer.threshold(stage), cols)
            renamed = {c: f"_{stage.name}_{c}_{i}" for c in ("label", "prob_true", "rationale")}
            rows = rows.withColumnsRenamed(renamed).drop("support", "against")
        screen, strict = (F.col(f"_{s.name}_label_{i}") for s in (SCREEN, CLASSIFY))
        passed = ~failed & (screen == "TRUE")

        def last(value: str, i: int = i, passed: Column = passed) -> Column:
            first, second = (F.col(f"_{s.name}_{value}_{i}") for s in (SCREEN, CLASSIFY))
            return F.when(passed, second).otherwise(F.when(~failed, first))

        results += [
            F.coalesce(skipped, screen).alias(settings.output_name(SCREEN)),
            F.coalesce(skipped, F.when(passed, strict)).alias(settings.output_name(CLASSIFY)),
            last("prob_true").alias(settings.prob_name),
        ]
        if settings.rationale:
            results.append(
                F.when(passed, F.col(f"_{CLASSIFY.name}_rationale_{i}")).alias(
                    settings.rationale_name(CLASSIFY)
                )
            )
    return rows.select("url", *results)
