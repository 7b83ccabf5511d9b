"""Lexicons and settings that give hits on the provided documents."""

from __future__ import annotations

import re

import pandas as pd

from screenflow.lexicon import Lexicon, Signal, words_lexicon
from screenflow.operators.score import SignalScorer
from screenflow.spec import CONTEXT_LIMIT, Settings

INSULT_WORDS = (
    "trash", "clown", "scum", "idiot", "worthless",
    "moron", "pathetic", "loser", "disgusting", "stupid",
)
FEW_WORDS = INSULT_WORDS[:5]
NOTICE_PHRASES = ("all rights reserved", "mit license", "apache license", "general public license")

INSULTS = words_lexicon("insult", INSULT_WORDS)
FEW_INSULTS = words_lexicon("insult", FEW_WORDS)
INSULTS_AND_NOTICES = Lexicon(
    (
        Signal("insult", INSULT_WORDS),
        Signal("notice", (*NOTICE_PHRASES, "copyright"), screen=-1, classify=-1, weight=0.5),
    )
)

OTHER_LABELS = ("true", "answer", "second")
SCREEN_AT, CLASSIFY_AT = 1.0, 3.0
SCORER = SignalScorer(INSULTS, SCREEN_AT, CLASSIFY_AT)
FEW_SCORER = SignalScorer(FEW_INSULTS, SCREEN_AT, CLASSIFY_AT)
FULL = Settings(
    model="insult words", model_label="full", rationale=True, context_limit=CONTEXT_LIMIT
)
FEW = Settings(model="few insult words", model_label="few", context_limit=CONTEXT_LIMIT)


def word_scorer(words: tuple[str, ...]):
    """A batch scorer in plain Python: replies in the way a model would."""

    def make(system_prompt: str):
        known = frozenset(words)
        cut = re.compile(r"[\W_]+")

        def score(texts: pd.Series) -> pd.DataFrame:
            hits = texts.map(lambda t: len(known.intersection(cut.split(t.lower()))))
            replies = hits.map(lambda n: "TRUE" if n else "The label is false")
            return pd.DataFrame({"reply": replies, "prob_true": hits / (hits + 1.0)})

        return score

    return make


def failing_scorer(every: int):
    """A batch scorer that fails on texts whose length is a multiple of ``every``."""

    def make(system_prompt: str):
        def score(texts: pd.Series) -> pd.DataFrame:
            size = texts.str.len()
            error = size.map(lambda n: f"failed on {n} characters" if n % every == 0 else None)
            return pd.DataFrame({"label": "TRUE", "error": error})

        return score

    return make
