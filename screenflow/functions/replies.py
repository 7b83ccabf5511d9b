"""Model replies to labels, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenflow.functions.strings import first_two_lines, strip
from screenflow.spec import LABELS, UNKNOWN

REPLY_SCHEMA = "label string, rationale string"


def parse_label(raw: Column, labels: Sequence[str] = LABELS) -> Column:
    """The exact label, else the earliest one at the start or after a space.

    Of labels that start at the same place the first declared one counts.
    """
    names = [label.upper() for label in labels]
    text = F.upper(strip(F.coalesce(raw, F.lit(""))))
    padded = F.concat(F.lit(" "), text)
    found = [
        F.when(
            F.contains(padded, F.lit(f" {name}")),
            F.struct(
                F.instr(padded, F.lit(f" {name}")).alias("at"),
                F.lit(i).alias("place"),
                F.lit(name).alias("name"),
            ),
        )
        for i, name in enumerate(names)
    ]
    earliest = F.array_min(F.array(*found))["name"]
    return F.when(text.isin(names), text).otherwise(F.coalesce(earliest, F.lit(UNKNOWN)))


def _is_object(raw: Column) -> Column:
    # `from_json` ignores text after the object, hence the closing brace check.
    return F.json_object_keys(raw).isNotNull() & F.endswith(strip(raw), F.lit("}"))


def parse_json_reply(raw: Column, labels: Sequence[str] = LABELS) -> Column:
    """``struct(label, rationale)`` of a JSON object reply, null for any other text."""
    reply = F.from_json(raw, REPLY_SCHEMA, {"allowSingleQuotes": "false"})
    rationale = strip(reply["rationale"])
    return F.when(
        _is_object(raw),
        F.struct(
            parse_label(reply["label"], labels).alias("label"),
            F.nullif(rationale, F.lit("")).alias("rationale"),
        ),
    )


def parse_line_reply(raw: Column, labels: Sequence[str] = LABELS) -> Column:
    """Line 1 is the label, line 2 (which may be empty) the rationale."""
    lines = first_two_lines(F.coalesce(raw, F.lit("")))
    return F.struct(
        parse_label(F.try_element_at(lines, F.lit(1)), labels).alias("label"),
        strip(F.try_element_at(lines, F.lit(2))).alias("rationale"),
    )


def parse_reply(raw: Column, labels: Sequence[str] = LABELS, rationale: bool = False) -> Column:
    """``struct(label, rationale)``: JSON first, then lines; label only without a rationale."""
    if not rationale:
        return F.struct(
            parse_label(raw, labels).alias("label"),
            F.lit(None).cast("string").alias("rationale"),
        )
    return F.coalesce(parse_json_reply(raw, labels), parse_line_reply(raw, labels))


def prob_true(tokens: Column, label: str = "TRUE") -> Column:
    """Probability of ``label`` from ``array<struct<token, logprob>>``; the last match wins."""
    hits = F.filter(tokens, lambda t: F.upper(strip(t["token"])) == F.lit(label))
    return F.exp(F.try_element_at(hits, F.lit(-1))["logprob"])
