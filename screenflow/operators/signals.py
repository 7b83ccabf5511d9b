"""Signal scorer: labels from the words and phrases of a lexicon.

Every step is a column expression over the row's own fields, so a pass over the
table is one scan without a shuffle or a Python worker. Each field is cut into
words once; all later set operations work on the few terms found in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.hashtags import compound_parts, hashtags
from screenflow.functions.strings import nonblank
from screenflow.lexicon import LYRIC_MARKERS, Lexicon
from screenflow.spec import TEXT_COLS

FIELD_WEIGHTS = {"description": 2.0}
MANY_HASHTAGS = 5
# Looking for one substring costs about 1/14 of cutting the text into words.
FEW_STEMS = 12
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
DESCRIPTION, TRANSCRIPT = "description", "transcript"
SILENT, TAGS, TAG_WORDS = "_silent", "_tags", "_tag_words"
# Stands between the words of a text and those of its compound tags, so that no phrase spans them.
APART = "|"


def _strings(values: Sequence[str]) -> Column:
    """An array literal; the split is folded when the query is optimised."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\n".join(values)), "\n")


def _low(field: str) -> Column:
    return F.col(f"_low_{field}")


def _found(field: str) -> Column:
    return F.col(f"_found_{field}")


def has_lyrics(low: Column) -> Column:
    """True when a lower-case transcript carries a lyrics marker."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in LYRIC_MARKERS])


def passes_stage(
    stage: str, threshold: float, support: Column, against: Column, agreeing: Column, silent: Column, lone: Column
) -> Column:
    """The rule of a stage; see `score_terms`."""
    if stage == "screen":
        return (support >= threshold) & (support >= against)
    passes = (support - against >= threshold) | (silent & (agreeing >= 2) & (support > against))
    return passes & ~lone


def probability(evidence: Column, threshold: float) -> Column:
    return 1.0 / (1.0 + F.exp(F.lit(threshold - 0.5) - evidence))


def rationale(hits: Column) -> Column:
    """The terms that spoke for a row; null if none did."""
    return F.when(F.size(hits) > 0, F.concat(F.lit("signals: "), F.array_join(hits, ", ")))


def find_terms(df: DataFrame, lexicon: Lexicon, cols: Sequence[str] = TEXT_COLS) -> DataFrame:
    """Replace the texts by what the rules need to know of them.

    That is one array of distinct lexicon terms per field (lyrics do not
    count), whether the transcript says nothing, and the description's hashtags.
    If the lexicon has ``tag_words``, a tag made up of these and the lexicon's words
    is read as its parts too.
    The result goes through a one-row `inline`: Spark does not push a later
    filter on a label below it, which would cut every text a second time.
    """
    fields = [c for c in cols if c in df.columns]
    words = [t for t in lexicon.terms() if " " not in t]
    # A phrase can only occur where its longest word does.
    anchors = {t: max(t.split(" "), key=len) for t in lexicon.terms() if " " in t}
    stems = sorted({*words, *anchors.values()})
    lyrics = has_lyrics(_low(TRANSCRIPT)) if TRANSCRIPT in fields else F.lit(False)

    compound = bool(lexicon.tag_words) and DESCRIPTION in fields
    joined = sorted({*lexicon.tag_words, *(w for t in lexicon.terms() for w in t.split(" "))})

    def is_known(word: Column) -> Column:
        return F.array_contains(_strings(joined), word)

    def tokens(field: str) -> Column:
        """The words of a field; none if, with a small lexicon, no term can be among them."""
        cut = F.split(_low(field), BETWEEN_WORDS)
        if field == DESCRIPTION and compound:
            apart = F.transform("_parts", lambda p: F.concat(F.array(F.lit(APART)), p))
            cut = F.concat(cut, F.flatten(apart))
        if len(stems) > FEW_STEMS:
            return cut
        possible = reduce(lambda a, b: a | b, [F.contains(_low(field), F.lit(x)) for x in stems])
        return F.when(possible, cut).otherwise(_strings([]))

    def line(field: str) -> Column:
        """The words as one text, for phrases; null where none can occur."""
        some = F.arrays_overlap(F.col(f"_stems_{field}"), _strings(sorted(set(anchors.values()))))
        return F.when(
            some, F.concat(F.lit(" "), F.array_join(f"_tokens_{field}", " "), F.lit(" "))
        )

    def terms(field: str) -> Column:
        found = F.col(f"_stems_{field}")
        if anchors:
            hits = [
                F.when(
                    F.array_contains(found, anchor)
                    & F.contains(F.col(f"_line_{field}"), F.lit(f" {phrase} ")),
                    F.lit(phrase),
                )
                for phrase, anchor in anchors.items()
            ]
            found = F.concat(
                F.array_intersect(found, _strings(words)), F.array_compact(F.array(*hits))
            )
        return F.when(lyrics, _strings([])).otherwise(found) if field == TRANSCRIPT else found

    facts = [terms(f).alias(f"_found_{f}") for f in fields]
    silent = ~nonblank(F.col(TRANSCRIPT)) | lyrics if TRANSCRIPT in fields else F.lit(True)
    facts.append(silent.alias(SILENT))
    if lexicon.hashtag_signal and DESCRIPTION in fields:
        parts = F.flatten("_parts") if compound else _strings([])
        facts += [F.col("_tags").alias(TAGS), F.concat("_tags", parts).alias(TAG_WORDS)]
    cut = df.withColumns({f"_low_{f}": F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields})
    if DESCRIPTION in fields and (compound or lexicon.hashtag_signal):
        cut = cut.withColumn("_tags", hashtags(_low(DESCRIPTION)))
    if compound:
        longest = max(map(len, joined))
        cut = cut.withColumn(
            "_parts", F.transform("_tags", lambda t: compound_parts(t, is_known, longest))
        ).withColumn("_parts", F.filter("_parts", lambda p: F.size(p) > 0))
    cut = (
        cut.withColumns({f"_tokens_{f}": tokens(f) for f in fields})
        .withColumns(
            {f"_stems_{f}": F.array_intersect(f"_tokens_{f}", _strings(stems)) for f in fields}
        )
    )
    if anchors:
        cut = cut.withColumns({f"_line_{f}": line(f) for f in fields})
    kept = [c for c in df.columns if c not in fields]
    return cut.select(*kept, F.inline(F.array(F.struct(*facts))))


def found_columns(df: DataFrame) -> list[str]:
    """The columns that `find_terms` added."""
    return [c for c in df.columns if c.startswith("_found_") or c in (SILENT, TAGS, TAG_WORDS)]


def _n_terms(found: Column, terms: Sequence[str]) -> Column:
    return F.size(F.array_intersect(found, _strings(terms)))


def _total(parts: list[Column]) -> Column:
    return reduce(add, parts, F.lit(0.0))


def score_terms(
    df: DataFrame,
    lexicon: Lexicon,
    stage: str,
    threshold: float,
    cols: Sequence[str] = TEXT_COLS,
) -> DataFrame:
    """Add ``support, against, label, prob_true, rationale`` of a stage to `find_terms` output.

    ``support`` and ``against`` weigh the distinct terms of the row. The screen
    passes a row with enough support that is not outweighed. The strict stage
    wants the net support, or agreeing fields where the transcript says
    nothing, and it ignores a lone condition hashtag among many others. The
    probability also weighs the field in which a term occurs.
    """
    fields = [c for c in cols if f"_found_{c}" in df.columns]
    everywhere = F.array_distinct(F.concat(*[_found(f) for f in fields]))
    positive = lexicon.terms(stage, 1)

    def side(sign: int) -> Column:
        return _total(
            [
                F.lit(s.weight) * _n_terms(F.col("_all"), s.terms)
                for s in lexicon.signals
                if s.polarity(stage) == sign
            ]
        )

    evidence = _total(
        [
            F.lit(FIELD_WEIGHTS.get(f, 1.0) * s.weight * s.polarity(stage))
            * _n_terms(_found(f), s.terms)
            for f in fields
            for s in lexicon.signals
            if s.polarity(stage)
        ]
    )
    scored = df.withColumn("_all", everywhere).withColumns(
        {
            "support": side(1),
            "against": side(-1),
            "_evidence": evidence,
            "_hits": F.array_sort(F.array_intersect(F.col("_all"), _strings(positive))),
        }
    )
    support, against = F.col("support"), F.col("against")
    agreeing = reduce(add, [(_n_terms(_found(f), positive) > 0).cast("int") for f in fields])
    lone = F.lit(False)
    if lexicon.hashtag_signal and TAGS in df.columns:
        conditions = lexicon.signal(lexicon.hashtag_signal).words
        lone = (
            (F.size(TAGS) >= MANY_HASHTAGS)
            & (_n_terms(F.col(TAG_WORDS), conditions) == 1)
            & (F.size("_hits") == 1)
        )
    passes = passes_stage(stage, threshold, support, against, agreeing, F.col(SILENT), lone)
    return scored.withColumns(
        {
            "label": F.when(passes, F.lit("TRUE")).otherwise(F.lit("FALSE")),
            "prob_true": probability(F.col("_evidence"), threshold),
            "rationale": rationale(F.col("_hits")),
        }
    ).drop("_all", "_evidence", "_hits")


def signal_scores(
    df: DataFrame,
    lexicon: Lexicon,
    stage: str,
    threshold: float,
    cols: Sequence[str] = TEXT_COLS,
) -> DataFrame:
    """Label every row of ``df`` for one stage; the text columns do not travel on."""
    found = find_terms(df, lexicon, cols)
    return score_terms(found, lexicon, stage, threshold, cols).drop(*found_columns(found))
