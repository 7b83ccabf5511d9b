"""Views of the provided tables in the layouts that the operators read.

The expressions are SQL that Spark and DuckDB understand alike, so both sides
of a comparison start from the same rows. The work to be compared is written
twice: with the library in `queries`, and in plain SQL in `oracle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.lexicon import MENTAL_HEALTH, TAG_WORDS
from screenflow.operators.term_chunks import Words, cut_small, distinct_runs

VIDEOS = {
    "url": "concat('doc:', doc_id)",
    "description": "case when doc_id % 3 <> 2 then text end",
    "transcript": "case when doc_id % 3 = 2 then text else '' end",
    "suggested_words": "concat(lang, ' ', source)",
    "scrape_status": "case doc_id % 17 when 0 then 'error' when 1 then null else 'ok' end",
    "ord": "doc_id",
}
COPIES = VIDEOS | {
    "description": "case when doc_id % 2 = 0 then 'an idiot' when doc_id % 3 <> 2 then text end",
    "scrape_status": "case when doc_id % 5 = 0 then 'error' else 'ok' end",
}
# Every fourth description has grown by words of the lexicon.
CHANGED = VIDEOS | {
    "description": "case when doc_id % 3 = 2 then null when doc_id % 4 = 0 then text || ' idiot clown scum' else text end",
}


def _one_of(words, place: str) -> str:
    return f"split_part('{','.join(words)}', ',', cast({place} % {len(words)} + 1 as int))"


# Documents with terms of the default lexicon, hashtags and lyrics put in by their ids.
TAGGED = {
    "url": "concat('doc:', doc_id)",
    "description": f"""case when doc_id % 5 = 0 then null else concat(
        coalesce(text, ''), ' ', {_one_of(MENTAL_HEALTH.terms(), 'doc_id')}, ' #',
        replace({_one_of(MENTAL_HEALTH.signals[0].terms, 'doc_id')}, ' ', ''), {_one_of(TAG_WORDS, 'floor(doc_id / 3)')},
        case doc_id % 4 when 0 then concat({_one_of(TAG_WORDS, 'doc_id')}, '_x') when 1 then 'zzz' else '' end,
        case when doc_id % 3 = 0 then ' #dog #cat #fun #thebrain #summer' else '' end) end""",
    "transcript": """case doc_id % 7 when 0 then concat('♪ depression ', text) when 1 then text
        when 2 then concat(text, ' my diagnosis and PTSD') when 3 then '  ' else null end""",
    "suggested_words": f"concat(lang, ' ', {_one_of(MENTAL_HEALTH.terms(), 'doc_id * 7')})",
}
TRUTH = {
    "url": "concat('doc:', doc_id)",
    "is_superficial_mental_health_handcoded": "case when toxic = 1 then 'TRUE' else 'FALSE' end",
    "is_mental_health_handcoded": (
        "case when toxic = 1 and quality = 1 then ' true ' else 'False' end"
    ),
    "use": "case when doc_id % 5 = 0 then ' Train' else 'test' end",
    "rationale": (
        "case when doc_id % 7 = 0 then 'n/a' when doc_id % 2 = 0 then concat('quality ', quality) end"
    ),
    "ord": "doc_id",
}
TRUTH_WITH_ISSUES = TRUTH | {
    "is_superficial_mental_health_handcoded": (
        "case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then 'maybe' "
        "when toxic = 1 then 'TRUE' else 'FALSE' end"
    ),
    "use": (
        "case when doc_id % 19 = 0 then null when doc_id % 5 = 0 then ' Train' else 'test' end"
    ),
}
LATER_TRUTH = TRUTH | {
    "is_superficial_mental_health_handcoded": (
        "case when (toxic = 1) <> (doc_id % 7 = 0) then 'TRUE' else 'FALSE' end"
    ),
    "ord": "doc_id + 1000000",
}
REPLIES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "raw": """case (conv_id + turn) % 8
        when 0 then 'TRUE'
        when 1 then concat(' false', chr(10))
        when 2 then 'The answer is TRUE because of the text'
        when 3 then '{"label":"TRUE","rationale":" r "}'
        when 4 then '{"label":true}'
        when 5 then concat('FALSE', chr(10), 'second line')
        when 6 then '[1]'
        else text end""",
}
BENCHMARK = {
    "task": "case item_id % 4 when 0 then 'DR' when 1 then 'CLP' when 2 then 'dreaddit' else 'loneliness' end",
    "idx": "cast(floor(item_id / 4) as bigint)",
    "query": """case
        when item_id % 7 = 0 then text
        when item_id % 5 = 0
            then concat('Consider this post: ', text, ' Question: Does the poster suffer?')
        else concat('Consider this post: "', text, '" Question: Does the poster suffer?') end""",
    "response": """case item_id % 3
        when 0 then concat('Yes, the poster does. Reasoning: ', text)
        when 1 then 'No.' else 'Unclear' end""",
}


# The signal, polarity and weight of a term of the corpus.
CORPUS_TERMS = {
    "signal": "concat('s', length(term) % 5)",
    "screen": "cast(case length(term) % 3 when 0 then 1 when 1 then -1 else 0 end as int)",
    "classify": "cast(case length(term) % 4 when 0 then 1 when 3 then -1 else 0 end as int)",
    "weight": "0.25e0 * (1 + length(term) % 4)",
}


def _view(spark: SparkSession, folder: str, table: str, columns: dict[str, str]) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return rows.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def videos(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "documents", VIDEOS)


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "documents", TAGGED)


def corpus_terms(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon out of the tables: words of the documents, pairs of the conversations, triples of the benchmark."""

    def runs(table: str, n: int) -> DataFrame:
        low = F.lower(F.coalesce("text", F.lit("")))
        texts = spark.read.parquet(f"{folder}/{table}.parquet")
        lines = texts.select(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")).alias("line"))

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut_small(batches):
                words = Words.of(batch["line"])
                yield pa.record_batch({"term": distinct_runs(words, words.begins(n), n)[1]})

        return lines.mapInArrow(distinct, "term string")

    terms = runs("documents", 1).union(runs("conversations", 2)).union(runs("benchmark", 3)).distinct()
    return terms.filter("length(term) > 2").selectExpr("*", *[f"{e} as {c}" for c, e in CORPUS_TERMS.items()])


def changed_videos(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "documents", CHANGED)


def videos_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every key twice; every other copy has another description, and some copies failed."""
    return videos(spark, folder).unionByName(_view(spark, folder, "documents", COPIES))


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "labels", TRUTH)


def truth_with_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "labels", TRUTH_WITH_ISSUES)


def truth_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every key twice; the later copy has some labels flipped."""
    return truth(spark, folder).unionByName(_view(spark, folder, "labels", LATER_TRUTH))


def truth_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Truth with the texts of its videos, as a truth file holds them."""
    texts = videos(spark, folder).select("url", "description", "transcript", "suggested_words")
    return truth(spark, folder).join(texts, "url")


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "conversations", REPLIES)


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "benchmark", BENCHMARK)


def cte(name: str, table: str, columns: dict[str, str], where: str = "") -> str:
    """The same view as a common table expression."""
    body = ", ".join(f"{e} as {c}" for c, e in columns.items())
    return f"{name} as (select {body} from {table} {where})"
