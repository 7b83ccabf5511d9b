"""Compound hashtags, cut into the words that they join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHTAG = r"#([\p{L}\p{N}_]+)"


def hashtags(low: Column) -> Column:
    """The tags of a lower-case text in order, without their ``#``."""
    found = F.regexp_extract_all(low, F.lit(HASHTAG), F.lit(1))
    return F.when(F.contains(low, F.lit("#")), found).otherwise(F.array().cast("array<string>"))


def break_words(text: Column, is_word: Callable[[Column], Column], longest: int) -> Column:
    """The fewest known words that make up ``text`` from end to end; empty if none do.

    Of several ways with the fewest words, the one with the longest last word counts,
    then the longest before it. ``longest`` is the length of the longest known word.
    The words are found by dynamic programming over the places of the text: the state
    holds the fewest words up to each of the last ``longest`` places, and for every
    place the length of the word that ends there.
    """

    def step(state: Column, place: Column) -> Column:
        def word(size: Column) -> Column:
            before = F.try_element_at(state["fewest"], size)
            known = before.isNotNull() & is_word(F.substr(text, place - size + 1, size))
            return F.when(known, F.struct((before + 1).alias("n"), (-size).alias("size")))

        sizes = F.sequence(F.lit(1), F.least(place, F.lit(longest)))
        best = F.array_min(F.array_compact(F.transform(sizes, word)))
        # One element, so that the choice is computed once for both parts of the state.
        grown = F.transform(
            F.array(best),
            lambda b: F.struct(
                F.slice(F.concat(F.array(b["n"]), state["fewest"]), 1, longest).alias("fewest"),
                F.concat(state["ends"], F.array(-b["size"])).alias("ends"),
            ),
        )
        return F.element_at(grown, 1)

    start = F.struct(
        F.array(F.lit(0)).alias("fewest"), F.array().cast("array<int>").alias("ends")
    )
    places = F.sequence(F.lit(1), F.length(text))

    def back(state: Column) -> Column:
        def take(found: Column, _: Column) -> Column:
            size = F.element_at(state["ends"], found["at"])
            part = F.substr(text, found["at"] - size + 1, size)
            return F.struct(
                (found["at"] - size).alias("at"), F.concat(F.array(part), found["parts"]).alias("parts")
            )

        begin = F.struct(F.length(text).alias("at"), F.array().cast("array<string>").alias("parts"))
        n = F.element_at(state["fewest"], 1)
        return F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), n), begin, take, lambda x: x["parts"]))

    broken = F.when(F.length(text) > 0, F.aggregate(places, start, step, back))
    return F.coalesce(broken, F.array().cast("array<string>"))


def compound_parts(tag: Column, is_word: Callable[[Column], Column], longest: int) -> Column:
    """The words of a tag that joins two or more; empty for other tags, such as those with an underscore."""
    parts = break_words(tag, is_word, longest)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
