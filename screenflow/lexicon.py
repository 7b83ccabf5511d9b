"""Signals: the criteria of the two stages as data.

A :class:`Signal` names one criterion, the words and phrases that point to it,
and which way it counts in each stage. The same list feeds the signal scorer
(`operators.signals`) and the default prompt templates (`spec`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_term(term: str) -> str:
    """A term as texts are read: lower-case runs of letters and digits of any script, one space between them."""
    words = " ".join(re.findall(r"[^\W_]+", term.lower()))
    if not words:
        raise ValueError(f"term {term!r} has neither letters nor digits")
    return words


@dataclass(frozen=True)
class Signal:
    """One criterion. ``screen`` / ``classify`` are +1, -1 or 0; ``terms`` are normalised."""

    name: str
    terms: tuple[str, ...]
    screen: int = 1
    classify: int = 1
    weight: float = 1.0
    criterion: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "terms", tuple(dict.fromkeys(normal_term(t) for t in self.terms)))

    def polarity(self, stage: str) -> int:
        return self.screen if stage == "screen" else self.classify

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(t for t in self.terms if " " not in t)

    @property
    def phrases(self) -> tuple[str, ...]:
        return tuple(t for t in self.terms if " " in t)


@dataclass(frozen=True)
class Lexicon:
    signals: tuple[Signal, ...]
    # Hashtags that count as the lone-hashtag case; the signal is named here.
    hashtag_signal: str | None = None
    # Words that may stand beside the lexicon's own in a compound hashtag; without any, tags are read whole.
    tag_words: tuple[str, ...] = ()

    def terms(self, stage: str | None = None, polarity: int | None = None) -> list[str]:
        """Distinct terms, optionally only those counting one way in a stage."""
        picked = {
            t: None
            for s in self.signals
            if polarity is None or s.polarity(stage or "screen") == polarity
            for t in s.terms
        }
        return list(picked)

    def signal(self, name: str) -> Signal:
        return next(s for s in self.signals if s.name == name)


# A lexicon of this kind becomes literals of the plan, so its size must be bounded.
# `operators.term_join.TermTable` takes a table of any size.
MAX_TERMS = 20_000


def lexicon_from_table(table: DataFrame, hashtag_signal: str | None = None) -> Lexicon:
    """Build a lexicon from ``(signal, term, screen, classify, weight)`` rows.

    The row count is checked on the cluster before any row reaches the driver.
    """
    n = table.count()
    if n > MAX_TERMS:
        raise ValueError(f"lexicon has {n} terms; at most {MAX_TERMS} can be inlined; use a TermTable")
    grouped = (
        table.groupBy("signal", "screen", "classify", "weight")
        .agg(F.array_sort(F.collect_set(F.lower("term"))).alias("terms"))
        .orderBy("signal")
        .collect()
    )
    return Lexicon(
        tuple(
            Signal(r["signal"], tuple(r["terms"]), r["screen"], r["classify"], float(r["weight"]))
            for r in grouped
        ),
        hashtag_signal,
    )


def words_lexicon(name: str, terms: Iterable[str]) -> Lexicon:
    """A one-signal lexicon that counts for both stages."""
    return Lexicon((Signal(name, tuple(terms)),))


# Markers that speech-to-text leaves around lyrics.
LYRIC_MARKERS = ("♪", "♫", "(singing)", "(music)")

# Words that are often joined to a condition in one hashtag.
TAG_WORDS = (
    "and", "advocate", "awareness", "brain", "check", "community", "day", "disorder", "family", "fighter",
    "girl", "girls", "health", "help", "humor", "in", "is", "journey", "kids", "life", "living", "matters",
    "memes", "mental", "mind", "mom", "month", "mum", "my", "not", "of", "parents", "people", "problems",
    "real", "recovery", "relatable", "stigma", "stories", "story", "students", "support", "survivor",
    "symptoms", "talk", "teen", "teens", "the", "tips", "tok", "treatment", "warrior", "week", "with", "women",
)

# The conditions, treatments and counter-examples that the
# screening criteria name. A space joins the words of a phrase; any character
# of a text that is neither a letter nor a digit separates words.
MENTAL_HEALTH = Lexicon(
    (
        Signal(
            "named_condition",
            (
                "depression", "anxiety", "anxiety disorder", "anxiety disorders", "adhd",
                "ptsd", "ocd", "bipolar", "bipolar disorder", "eating disorder",
                "eating disorders", "self harm", "psychosis", "autism", "autism spectrum",
                "bpd", "phobia", "phobias", "substance use disorder", "dissociation",
            ),
            criterion="names a mental health condition in any field or hashtag",
        ),
        Signal(
            "treatment",
            (
                "therapist", "psychologist", "psychiatrist", "psychiatric medication",
                "psychiatric hospitalisation", "mental health diagnosis", "therapy session",
                "therapy sessions", "trauma therapy", "psychotherapy", "ifs", "cbt", "dbt",
            ),
            criterion="speaks of psychological or psychiatric treatment",
        ),
        Signal(
            "lived_experience",
            ("my symptoms", "my diagnosis", "crash out", "being sectioned", "masking"),
            criterion="describes own symptoms or uses the slang of a condition",
        ),
        Signal(
            "community",
            (
                "mental health awareness", "mental health community", "adhd community",
                "bpd community", "autism community", "my adhd be like",
            ),
            criterion="offers peer support or identity around a condition",
        ),
        Signal(
            "coping",
            ("coping strategies", "coping strategy", "coping skills"),
            screen=0,
            criterion="shares ways of coping with a condition",
        ),
        Signal(
            "grief_or_trauma",
            ("bereavement", "grief", "loss of a loved one", "traumatic"),
            screen=0,
            criterion="discusses the psychological impact of profound grief or trauma",
        ),
        Signal(
            "hyperbole",
            ("so depressing", "so ocd", "ptsd from this", "ringtone ptsd"),
            screen=-1, classify=-1, weight=2.0,
            criterion="uses a condition only as a joke or exaggeration",
        ),
        Signal(
            "wellness",
            ("ocean therapy", "retail therapy", "colouring therapy", "good for my mental health"),
            screen=-1, classify=-1,
            criterion="is general wellness or relaxation",
        ),
        Signal(
            "physical_health",
            (
                "chemotherapy", "cancer", "sickle cell", "pcos", "hypermobility", "eds",
                "chronic pain", "wheelchair", "food allergies", "cosmetic surgery",
            ),
            screen=-1, classify=-1,
            criterion="is about physical health alone",
        ),
        Signal(
            "routine_emotion",
            ("unrequited love", "heartbreak", "relationship drama", "career frustration"),
            screen=0, classify=-1,
            criterion="is an everyday emotion without a condition",
        ),
        Signal(
            "colloquial_narcissism",
            ("narcissist", "narcissism", "toxic"),
            screen=0, classify=-1,
            criterion="calls a person narcissistic or toxic without clinical framing",
        ),
    ),
    hashtag_signal="named_condition",
    tag_words=TAG_WORDS,
)
