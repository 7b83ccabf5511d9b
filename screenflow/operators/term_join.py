"""Signals of a lexicon of any size: a table of terms that texts meet in a join.

The counterpart of `signals` for lexicons that are too large for literals of a plan.
A text is cut into words by place, and its runs of consecutive words, of each length
that some term has, meet the terms by equality: no phrase is looked for twice, no
common word meets the phrases that merely contain it, and nothing of the lexicon is
in the plan but the first words of the terms of a length, if they are few: then only
runs that begin with one are formed. Texts stay where they are. If the stored term table is small, the planner
broadcasts it by its size and only matches are shuffled; if not, distinct runs are, and
the adaptive skew join splits frequent ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.hashtags import compound_parts, hashtags
from screenflow.functions.strings import named, nonblank
from screenflow.operators.signals import (
    BETWEEN_WORDS,
    DESCRIPTION,
    FIELD_WEIGHTS,
    MANY_HASHTAGS,
    SILENT,
    TRANSCRIPT,
    has_lyrics,
    passes_stage,
    probability,
    rationale,
)
from screenflow.operators.term_chunks import BODY, BUCKET, CHUNK, LINE, PLACE, answers, askers, buckets_of, chunks_of, sieve_of, summed, term_cells
from screenflow.sources.scratch import shuffles_dropped, stored
from screenflow.spec import TEXT_COLS

KEY, CONTENT, N_TAGS, CONDITIONS = "_key", "_content", "_n_tags", "_conditions"
POLARITIES = ("screen", "classify")
#: The field of whole hashtags and their parts, which only the lone-hashtag rule reads.
TAG_FIELD = "#"
#: Up to as many first words of the terms of a length stand in the plan and save all other runs.
MAX_FIRST_WORDS = 1_000
#: What makes two matches of a text one, whatever their fields.
ENTRY = ("term", "signal", "screen", "classify", "weight")


def normal_terms(table: DataFrame) -> DataFrame:
    """Distinct ``signal, term, n_words, screen, classify, weight`` as texts are read.

    A term is lower-cased and its runs of letters and digits are joined by one space.
    A term without any fails the job; so does a null one.
    """
    words = F.filter(F.split(F.lower("term"), BETWEEN_WORDS), lambda w: w != "")
    term = F.array_join(words, " ")
    empty = F.raise_error(F.format_string("term %s has neither letters nor digits", F.col("term")))
    return table.select(
        "signal",
        F.when(F.coalesce(F.size(words), F.lit(0)) > 0, term).otherwise(empty).alias("term"),
        F.size(words).alias("n_words"),
        F.col("screen").cast("int").alias("screen"),
        F.col("classify").cast("int").alias("classify"),
        F.col("weight").cast("double").alias("weight"),
    ).distinct()


@dataclass(frozen=True)
class TermTable:
    """A stored lexicon. ``words`` may join its words in compound hashtags; both are tables."""

    terms: DataFrame
    lengths: tuple[int, ...]
    words: DataFrame | None = None
    longest_word: int = 0
    hashtag_signal: str | None = None
    #: First words of the terms of a length, where they are at most `MAX_FIRST_WORDS`.
    first_words: dict[int, tuple[str, ...]] = field(default_factory=dict)
    #: Bits of a slot, the slots that some term has, and the number of terms; only if the first words of a length are too many.
    sieve: tuple[int, Broadcast, int] | None = None

    @classmethod
    def store(
        cls, table: DataFrame, hashtag_signal: str | None = None, tag_words: DataFrame | None = None
    ) -> TermTable:
        """Write the normal terms of ``(signal, term, screen, classify, weight)`` rows once.

        Only the distinct lengths of terms, in words, a few first words and a sieve of at most
        32 MB reach the driver.
        With ``tag_words`` (``word``), tags made up of these and the lexicon's words count for
        their parts.
        """
        with shuffles_dropped(table.sparkSession):
            return cls._store(table, hashtag_signal, tag_words)

    @classmethod
    def _store(cls, table: DataFrame, hashtag_signal: str | None, tag_words: DataFrame | None) -> TermTable:
        terms = stored(normal_terms(table), "terms")
        firsts = terms.select("n_words", F.substring_index("term", " ", 1).alias("word")).distinct()
        counts = {r["n_words"]: r["n"] for r in firsts.groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [n for n, count in counts.items() if count <= MAX_FIRST_WORDS]
        first_words: dict[int, list[str]] = {n: [] for n in few}
        for r in firsts.filter(F.col("n_words").isin(few)).collect() if few else []:
            first_words[r["n_words"]].append(r["word"])
        words, longest = None, 0
        if tag_words is not None:
            own = terms.select(F.explode(F.split("term", " ")).alias("word"))
            more = tag_words.select(F.lower("word").alias("word")).filter("word <> ''")
            words = stored(own.union(more).distinct(), "tag-words")
            longest = words.agg(F.max(F.length("word")).alias("n")).first()["n"] or 0
        few_words = {n: tuple(sorted(found)) for n, found in first_words.items()}
        sieve = None
        if len(few) < len(counts):
            n_terms = terms.count()
            bits, slots = sieve_of(terms, n_terms)
            sieve = bits, terms.sparkSession.sparkContext.broadcast(slots), n_terms
        return cls(terms, tuple(sorted(counts)), words, longest, hashtag_signal, few_words, sieve)


def tag_parts(tags: DataFrame, lexicon: TermTable) -> DataFrame:
    """``tag, parts`` of the distinct ``tag`` values that join two or more known words.

    The pieces of a tag meet the word table; the ones found are all that the dynamic
    programme of that tag has to know.
    """
    sizes = F.sequence(F.lit(1), F.least(F.length("tag") - F.col("at") + 1, F.lit(lexicon.longest_word)))
    pieces = (
        tags.select("tag").distinct().filter("tag <> ''")
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("tag"))))
        .select("tag", F.explode(F.transform(sizes, lambda n: F.substr("tag", F.col("at"), n))).alias("word"))
    )
    known = pieces.join(lexicon.words, "word").groupBy("tag").agg(F.collect_set("word").alias("known"))
    parts = compound_parts(F.col("tag"), lambda w: F.array_contains(F.col("known"), w), lexicon.longest_word)
    return known.select("tag", parts.alias("parts")).filter(F.size("parts") > 0)


def _low(field: str) -> Column:
    return F.lower(F.coalesce(named(field), F.lit("")))


def word_lists(df: DataFrame, lexicon: TermTable, fields: Sequence[str], lines: bool = False) -> DataFrame:
    """``_key, _content, field, words``: the words of every field by place, then those of tags.

    The words are an array, or with ``lines`` a text with one space between two of them.
    """
    texts = [F.struct(F.lit(f).alias("field"), _low(f).alias("low")) for f in fields]
    each = df.select(KEY, CONTENT, F.inline(F.array(*texts))).filter("low <> ''")
    if TRANSCRIPT in fields:
        each = each.filter(~((F.col("field") == TRANSCRIPT) & has_lyrics(F.col("low"))))
    cut = F.regexp_replace("low", BETWEEN_WORDS, " ") if lines else F.split("low", BETWEEN_WORDS)
    lists = each.select(KEY, CONTENT, "field", cut.alias("words"))
    if DESCRIPTION not in fields or (lexicon.words is None and lexicon.hashtag_signal is None):
        return lists
    tagged = df.select(KEY, CONTENT, F.explode(hashtags(_low(DESCRIPTION))).alias("tag")).distinct()
    if lexicon.words is not None:
        tagged = stored(tagged, "tags")
        parts = tagged.join(tag_parts(tagged, lexicon), "tag").select(KEY, CONTENT, "parts")
        for field in (DESCRIPTION, TAG_FIELD):
            lists = lists.union(parts.select(KEY, CONTENT, F.lit(field), F.array_join("parts", " ") if lines else "parts"))
    return lists.union(tagged.select(KEY, CONTENT, F.lit(TAG_FIELD), "tag" if lines else F.array("tag")))


def runs_of(words: str, lexicon: TermTable, n: int) -> Column:
    """The runs of ``n`` consecutive words that may be terms; null in place of the others."""

    def run(word: Column, at: Column) -> Column:
        joined = F.concat(word, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, at + k))])
        return F.when(word.isin(*lexicon.first_words[n]), joined) if n in lexicon.first_words else joined

    if n == 1 and n not in lexicon.first_words:
        return F.col(words)
    return F.transform(words, run)


def _facts(bit: dict[str, int], hashtag_signal: str | None) -> list[Column]:
    """What each stage has to know of the entries of a text; ``_places`` holds their fields."""
    texts = sum(b for name, b in bit.items() if name != TAG_FIELD)
    has = lambda b: F.col("_places").bitwiseAND(F.lit(b)) > 0
    times = reduce(add, [F.when(has(b), F.lit(FIELD_WEIGHTS.get(name, 1.0))).otherwise(0.0) for name, b in bit.items() if name != TAG_FIELD], F.lit(0.0))
    facts = [F.collect_set(F.when(has(bit[TAG_FIELD]) & (F.col("signal") == hashtag_signal), F.col("term"))).alias(CONDITIONS)] if hashtag_signal else []
    for stage in POLARITIES:
        side = lambda sign: has(texts) & (F.col(stage) == sign)  # noqa: E731, B023
        # An unknown addend makes the sum of a row 0.
        total = lambda of, value: F.when(F.bool_or(of & value.isNull()), F.lit(0.0)).otherwise(F.sum(F.when(of, value)))
        facts += [
            total(side(1), F.col("weight")).alias(f"_support_{stage}"),
            total(side(-1), F.col("weight")).alias(f"_against_{stage}"),
            total(has(texts), times * F.col("weight") * F.col(stage)).alias(f"_evidence_{stage}"),
            F.bit_or(F.when(side(1), F.col("_places").bitwiseAND(F.lit(texts))).otherwise(0)).alias(f"_fields_{stage}"),
            F.collect_set(F.when(side(1), F.col("term"))).alias(f"_hits_{stage}"),
        ]
    return facts


def fact_columns(df: DataFrame) -> list[str]:
    """The columns that `match_terms` added."""
    added = {SILENT, N_TAGS, CONDITIONS, *(f"_{x}_{p}" for p in POLARITIES for x in ("support", "against", "evidence", "fields", "hits"))}
    return [c for c in df.columns if c in added]


def _place(bit: dict[str, int]) -> Column:
    return reduce(lambda other, name: F.when(F.col("field") == name, F.lit(bit[name])).otherwise(other), bit, F.lit(0))


def _flat_matches(lists: DataFrame, lexicon: TermTable, bit: dict[str, int]) -> DataFrame:
    """The facts of each text that has terms, by a row for each match."""
    # Whole hashtags and their parts are looked up as single words.
    single = F.array_compact(runs_of("words", lexicon, 1)) if 1 in lexicon.lengths else F.array().cast("array<string>")
    longer = [F.array_compact(runs_of("words", lexicon, n)) for n in lexicon.lengths if n > 1]
    runs = F.when(F.col("field") == TAG_FIELD, single).otherwise(F.flatten(F.array(single, *longer)))
    found = (
        lists.select(KEY, CONTENT, "field", F.explode(F.array_distinct(runs)).alias("term"))
        .join(lexicon.terms.drop("n_words"), "term")
    )
    # One row for each entry of a text, with a bit for each field that has it; both groupings
    # use the exchange by text.
    entries = found.withColumn("_bit", _place(bit)).repartition(KEY, CONTENT).groupBy(KEY, CONTENT, *ENTRY).agg(F.bit_or("_bit").alias("_places"))
    return entries.groupBy(KEY, CONTENT).agg(*_facts(bit, lexicon.hashtag_signal))


def _chunk_matches(lists: DataFrame, lexicon: TermTable, bit: dict[str, int], n: int) -> DataFrame:
    """The same facts by ``n`` chunks of texts; terms that hit are one text, a term in a line."""
    chunk = F.pmod(F.xxhash64(KEY, CONTENT), F.lit(n)).cast("int")
    lines = lists.select(chunk.alias(CHUNK), KEY, CONTENT, _place(bit).alias(PLACE), F.col("words").alias(LINE)).repartitionById(n, F.col(CHUNK))
    bits, slots, n_terms = lexicon.sieve
    n_buckets = buckets_of(n_terms, n)
    ask = askers(lexicon.lengths, bits, slots, bit[TAG_FIELD], n_buckets)
    asked = lines.groupBy(CHUNK).applyInArrow(ask, f"{BUCKET} int, {CHUNK} int, {BODY} binary").repartitionById(n_buckets, F.col(BUCKET))
    named_ = [(F.col("signal") == lexicon.hashtag_signal).cast("int").alias("named")] if lexicon.hashtag_signal else []
    terms = lexicon.terms.select("term", *named_, "weight", *POLARITIES)
    cells = terms.mapInArrow(term_cells(n_buckets, terms.columns[1:]), f"{BUCKET} int, {BODY} binary").repartitionById(n_buckets, F.col(BUCKET))
    answered = asked.groupBy(BUCKET).cogroup(cells.groupBy(BUCKET)).applyInArrow(answers(terms.columns[1:]), f"{CHUNK} int, {BODY} binary").repartitionById(n, F.col(CHUNK))
    weights = {b: FIELD_WEIGHTS.get(name, 1.0) for name, b in bit.items() if name != TAG_FIELD}
    sum_up = summed(weights, bit[TAG_FIELD], POLARITIES, CONDITIONS if lexicon.hashtag_signal else None, KEY, CONTENT)
    facts = [f"{CONDITIONS} string"] if lexicon.hashtag_signal else []
    for p in POLARITIES:
        facts += [f"_support_{p} double", f"_against_{p} double", f"_evidence_{p} double", f"_fields_{p} int", f"_hits_{p} string"]
    schema = ", ".join([f"{KEY} string", f"{CONTENT} bigint", *facts])
    return lines.groupBy(CHUNK).cogroup(answered.groupBy(CHUNK)).applyInArrow(sum_up, schema)


def match_terms(df: DataFrame, lexicon: TermTable, cols: Sequence[str] = TEXT_COLS, key: str = "url") -> DataFrame:
    """Replace the texts by what the stages need to know of the distinct terms found per field.

    That is sums of weights, the fields and the terms themselves. Also adds whether the transcript says nothing and the number of hashtags. Rows are
    told apart by key and content, so copies of a key with other texts keep their own
    matches; a null key counts as empty.
    """
    fields = [c for c in cols if c in df.columns]
    texts = [named(f) for f in fields]
    rows = df.withColumn(KEY, F.coalesce(named(key).cast("string"), F.lit(""))).withColumn(CONTENT, F.xxhash64(F.lit(0), *texts))
    # A bit for each field, and one for the hashtags.
    bit = {name: 1 << k for k, name in enumerate([*fields, TAG_FIELD])}
    lists = word_lists(rows, lexicon, fields, lines=lexicon.sieve is not None)
    matches = _flat_matches(lists, lexicon, bit) if lexicon.sieve is None else _chunk_matches(lists, lexicon, bit, chunks_of(df, texts))
    if TRANSCRIPT in fields:
        silent = ~nonblank(named(TRANSCRIPT)) | has_lyrics(_low(TRANSCRIPT))
    else:
        silent = F.lit(True)
    n_tags = F.size(hashtags(_low(DESCRIPTION))) if DESCRIPTION in fields else F.lit(0)
    kept = [named(c) for c in df.columns if c not in fields]
    facts = rows.select(*kept, KEY, CONTENT, silent.alias(SILENT), n_tags.alias(N_TAGS))
    found = facts.join(matches, [KEY, CONTENT], "left").drop(KEY, CONTENT)
    if lexicon.sieve is None:
        return found
    return found.withColumns({c: F.split(c, "\n") for c in fact_columns(found) if c == CONDITIONS or c.startswith("_hits_")})


def score_matches(df: DataFrame, lexicon: TermTable, stage: str, threshold: float) -> DataFrame:
    """Add ``support, against, label, prob_true, rationale`` of a stage to `match_terms` output."""
    polarity = "screen" if stage == "screen" else "classify"
    number = lambda name: F.coalesce(F.col(f"_{name}_{polarity}"), F.lit(0.0))
    hits = F.coalesce(F.array_sort(f"_hits_{polarity}"), F.array().cast("array<string>"))
    scored = df.withColumns({"support": number("support"), "against": number("against"), "_hits": hits})
    lone = F.lit(False)
    if lexicon.hashtag_signal and stage != "screen":
        named_ = F.coalesce(F.size(CONDITIONS), F.lit(0))
        lone = (F.col(N_TAGS) >= MANY_HASHTAGS) & (named_ == 1) & (F.size("_hits") == 1)
    agreeing = F.coalesce(F.bit_count(f"_fields_{polarity}"), F.lit(0))
    passes = passes_stage(stage, threshold, F.col("support"), F.col("against"), agreeing, F.col(SILENT), lone)
    return scored.withColumns(
        {
            "label": F.when(passes, F.lit("TRUE")).otherwise(F.lit("FALSE")),
            "prob_true": probability(number("evidence"), threshold),
            "rationale": rationale(F.col("_hits")),
        }
    ).drop("_hits")
