"""Stages and run settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from screenflow.lexicon import MENTAL_HEALTH, Lexicon

# Labels, field names, message formats and limits that stored
# results, truth files and run logs have in common.
LABELS = ("TRUE", "FALSE")
SKIPPED = "SKIPPED"
TOO_LONG = "TOO_LONG"
UNKNOWN = "UNKNOWN"
FAILED_STATUS = "error"
TEXT_COLS = ("description", "transcript", "suggested_words")
USER_TEMPLATE = "Video metadata:\n{text}"
EXAMPLES_SLOT = "{examples}"
RATIONALE_REQUEST = "\n\nAlso provide a one-sentence rationale explaining your decision."
RATIONALE_BUDGET = 100
LABEL_BUDGET_MARGIN = 10
CONTEXT_LIMIT = 4096
CHARS_PER_TOKEN = 4
BENCHMARK_TASKS = ("DR", "CLP", "dreaddit", "loneliness")
BENCHMARK_KEY_PREFIX = "imhi"


@dataclass(frozen=True)
class StageSpec:
    """What differs between the stages; everything else is shared code."""

    name: str
    output_col: str
    truth_col: str
    template: str
    examples_with_rationale: bool
    gate: str | None = None  # stage whose TRUE rows this stage scores

    def with_template(self, template: str) -> StageSpec:
        return replace(self, template=template)


# Criteria that no list of terms can express, by stage and direction.
FURTHER_CRITERIA = {
    "screen": {
        1: ("its hashtags or search terms hint at such a topic, even if its text does not",),
        -1: ("the words belong to song lyrics, and nothing else points to the topic",),
    },
    "classify": {
        1: (
            "nobody speaks in it (silence or music alone), and several other fields agree on one "
            "condition as its main subject",
            "it is about physical illness, but also names or clearly describes a mental health "
            "condition that comes with it",
        ),
        -1: (
            "one condition hashtag stands among many that have nothing to do with it, and the rest "
            "is about something else",
            "the words belong to song lyrics, and the speaker says nothing of the kind outside them",
            "the topic is mentioned in passing, in a video about something else",
            "it tells of another person's or a fictional character's condition, without a personal "
            "tie or solidarity",
            "it shows everyday stress or conflict that no condition explains",
        ),
    },
}


def default_template(stage: str, lexicon: Lexicon = MENTAL_HEALTH) -> str:
    """Render a stage's prompt from the signals that count in it."""
    opening = {
        "screen": "Decide whether a video might relate to mental health. "
        "A wrong TRUE is cheaper than a missed video: when unsure, answer TRUE.",
        "classify": "The video passed a broad filter. "
        "Decide whether it truly engages with mental health.",
    }[stage]

    def bullets(sign: int) -> str:
        named = [f"it {s.criterion}" for s in lexicon.signals if s.polarity(stage) == sign and s.criterion]
        return "\n".join(f"- {line}" for line in [*named, *FURTHER_CRITERIA[stage][sign]])

    return (
        f"{opening} Read the fields together; the description counts most.\n\n"
        f"Answer TRUE if any of these holds:\n{bullets(1)}\n\n"
        f"Answer FALSE if the topic appears only because:\n{bullets(-1)}\n\n"
        f"Answer with one token, TRUE or FALSE.\n\n{EXAMPLES_SLOT}"
    )


SCREEN = StageSpec(
    name="screen",
    output_col="is_mental_health_broad",
    truth_col="is_superficial_mental_health_handcoded",
    template=default_template("screen"),
    examples_with_rationale=False,
)
CLASSIFY = StageSpec(
    name="classify",
    output_col="is_mental_health",
    truth_col="is_mental_health_handcoded",
    template=default_template("classify"),
    examples_with_rationale=True,
    gate="screen",
)
STAGES = {s.name: s for s in (SCREEN, CLASSIFY)}


@dataclass(frozen=True)
class Settings:
    """Settings of one run, as they are logged."""

    model: str
    model_label: str
    backend: str = "signals"
    labels: tuple[str, ...] = LABELS
    cols: tuple[str, ...] = TEXT_COLS
    rationale: bool = False
    row_filter: str | None = None
    output_col: str | None = None
    context_limit: int | None = None  # tokens; with it, rows estimated to be longer are not scored
    concurrency: int = 4
    max_tries: int | None = None  # rows that failed as often are not tried again
    rescore_changed: bool = False  # rows whose texts changed since they were labelled are due again

    def label_set(self) -> tuple[str, ...]:
        return tuple(label.upper() for label in self.labels)

    def output_name(self, stage: StageSpec) -> str:
        return f"{self.output_col or stage.output_col}_{self.model_label}"

    def rationale_name(self, stage: StageSpec) -> str:
        return f"{self.output_name(stage)}_rationale"

    @property
    def prob_name(self) -> str:
        return f"prob_true_{self.model_label}"

    def output_budget(self) -> int:
        """Tokens the reply may use."""
        if self.rationale:
            return RATIONALE_BUDGET
        return max(len(label.split()) for label in self.labels) + LABEL_BUDGET_MARGIN
