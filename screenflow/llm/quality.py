"""Quality rules with adaptive thresholds, all in column expressions.

Each metric of a document is an integer. Its distribution in a language and
source is kept as a mergeable quantile sketch: counts by log-linear bucket
(exact below 32, then 16 buckets for each power of two, a relative error of at
most 1/16). Sketches merge by adding counts, so they combine on the map side, and
roll up to the language and to everything. The threshold of a metric is its median plus
a multiple of the distance from the lower decile, which the worse half of a source cannot
move, or its upper decile if that is more: most documents have no symbols or
repeated lines at all, and a source in which a tenth has some gets a threshold from those.
A source's thresholds are drawn towards its language's, and those towards everything's, by
numbers of documents, so they move smoothly as a source grows. Documents then
meet their thresholds in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from screenflow.llm.common import GAP, WORD, col, free_name, stored

SYMBOLS = "#*$%&|<>"
#: What a metric may exceed its quantiles by: thousandths, and tenths of a character for word length.
SLACK = {"symbols": 30, "capitals": 100, "dup_lines": 350, "word_length": 50}
METRICS = tuple(SLACK)
#: Distances from the lower decile to the median that a document may be above the median.
REACH = 6
#: Documents that the next wider group (the language, then all documents) counts for in a group's threshold.
PRIOR_DOCS = 100
REPEAT_WINDOW = 5


def thousandths(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("bigint")


def cheap_metrics(text: Column) -> dict[str, Column]:
    """Counts that need no array of words."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.regexp_replace(line, GAP, "")) > 0)
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint"),
        "lines": lines,
    }


def measured(docs: DataFrame, text: Column, repeats: bool) -> DataFrame:
    """``docs`` with the base counts and the metrics, all under names starting with ``q_``.

    ``repeats`` adds ``q_n_repeat_words``, for which the words are laid out.
    """
    out = docs.withColumns({f"q_{k}": v for k, v in cheap_metrics(text).items()})
    out = out.withColumns({
        "q_n_lines": F.size("q_lines").cast("bigint"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"),
    }).drop("q_lines")
    out = out.withColumns({
        "q_symbols": thousandths(F.col("q_n_symbols"), F.col("q_word_chars")),
        "q_capitals": thousandths(F.col("q_n_capitals"), F.col("q_word_chars")),
        "q_dup_lines": thousandths(F.col("q_n_dup_lines"), F.col("q_n_lines")),
        "q_word_length": F.when(F.col("q_n_words") > 0, F.floor(F.col("q_word_chars") * 10 / F.col("q_n_words"))).otherwise(0).cast("bigint"),
    })
    return repeat_words(out, text) if repeats else out


def repeat_words(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``q_n_repeat_words``: words inside 5-word windows that the text has at least twice.

    Distinct window hashes prove that nothing repeats. Only other texts have
    their windows sorted, as strings, so equal hashes decide nothing.
    """
    w = REPEAT_WINDOW
    out = docs.withColumn("q_words", F.filter(F.split(text, GAP), lambda x: x != ""))
    starts = F.when(F.size("q_words") >= w, F.sequence(F.lit(0), F.size("q_words") - w)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get("q_words", i + k) for k in range(w))))
    out = out.withColumn("q_hashes", hashes)
    out = out.withColumn("q_repeats", F.size("q_hashes") != F.size(F.array_distinct("q_hashes"))).drop("q_hashes")
    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("q_words", i + 1, w), " ").alias("text"), i.alias("at")))
    out = out.withColumn("q_sorted", F.when(F.col("q_repeats"), F.sort_array(windows)))
    same = lambda j, k: F.get("q_sorted", j)["text"] == F.get("q_sorted", k)["text"]
    last = F.size("q_sorted") - 1
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j - 1, j)) | ((j < last) & same(j, j + 1)))
    out = out.withColumn("q_twice", F.when(F.col("q_repeats"), F.sort_array(F.transform(twice, lambda j: F.get("q_sorted", j)["at"])))).drop("q_sorted")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("q_twice", start, lambda s, at: F.struct((s["n"] + w - F.greatest(s["end"] - at, F.lit(0))).alias("n"), (at + w).alias("end")))
    return out.withColumn("q_n_repeat_words", F.coalesce(covered["n"], F.lit(0).cast("bigint"))).drop("q_words", "q_repeats", "q_twice")


def bucket(value: Column) -> Column:
    """The sketch bucket of a value: itself below 32, else 16 buckets for each power of two."""
    bits = F.length(F.bin(value))
    sub = F.floor(value / F.pow(F.lit(2), bits - 5)).cast("bigint")
    return F.when(value < 32, value).otherwise(32 + (bits - 6) * 16 + sub - 16).cast("bigint")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    step = F.floor((b - 32) / 16) + 1
    top = (((b - 32) % 16 + 17) * F.pow(F.lit(2), step) - 1).cast("bigint")
    return F.when(b < 32, b).otherwise(top)


def sketch(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """``lang, source, metric, bucket, n`` over all documents."""
    rows = measured(docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), text.alias("body")), F.col("body"), repeats=False)
    metrics = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(f"q_{m}")).alias("bucket")) for m in METRICS))
    return rows.select("lang", "source", F.inline(metrics)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, docs, fence`` of the sketches merged to ``keys``."""
    merged = counts.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    quantile = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("docs") * q, F.col("bucket")))
    found = ranked.groupBy(*keys, "metric", "docs").agg(
        *(bucket_top(quantile(q)).alias(name) for name, q in (("low", 10), ("middle", 50), ("high", 90)))
    )
    slack = F.create_map(*(F.lit(x) for pair in SLACK.items() for x in pair))
    usual = F.greatest(F.col("middle") + REACH * (F.col("middle") - F.col("low")), F.col("high"))
    return found.select(*keys, "metric", "docs", (usual + slack[F.col("metric")]).cast("bigint").alias("fence"))


def drawn(fence: Column, docs: Column, wider: Column) -> Column:
    """A group's fence, drawn towards the wider group's as if that were ``PRIOR_DOCS`` more documents."""
    return F.floor((fence * docs + wider * PRIOR_DOCS) / (docs + PRIOR_DOCS))


def thresholds(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``q_lang, q_source`` and a ``q_max_<metric>`` column for each metric."""
    counts = stored(sketch(docs, col(lang_col), col(source_col), F.coalesce(col(text_col), F.lit(""))), "quality-sketch")
    own = fences(counts, ["lang", "source"])
    language = fences(counts, ["lang"]).select("lang", "metric", F.col("docs").alias("lang_docs"), F.col("fence").alias("lang_fence"))
    every = fences(counts, []).select("metric", F.col("fence").alias("all_fence"))
    chosen = own.join(language, ["lang", "metric"]).join(every, "metric")
    fence = drawn(F.col("fence"), F.col("docs"), drawn(F.col("lang_fence"), F.col("lang_docs"), F.col("all_fence")))
    table = chosen.groupBy(F.col("lang").alias("q_lang"), F.col("source").alias("q_source")).agg(
        *(F.max(F.when(F.col("metric") == m, fence)).alias(f"q_max_{m}") for m in METRICS)
    )
    return stored(table, "quality-thresholds")


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the ``q_`` counts and metrics, ``q_base_failed`` and ``q_kept``.

    The base rule rejects fewer than 10 words, or more than a fifth of the words
    in repeated windows. The adaptive rule rejects a document above any of the
    thresholds of its language and source. Texts are read whole. Null and empty
    texts have no words and fail; a null language or source counts as an empty
    string; repeated rows are judged alike and each count in the sketches. An
    empty table gives an empty result. Input columns starting with ``q_`` are
    not supported by this function; ``keep_good`` and the query drop to the
    columns they need first.
    """
    limits = thresholds(docs, lang_col, source_col, text_col)
    rows = measured(docs, F.coalesce(col(text_col), F.lit("")), repeats=True)
    # Small limits are broadcast by the planner, from the size of their file; else a frequent source is split.
    keys = (F.coalesce(col(lang_col), F.lit("")) == F.col("q_lang")) & (F.coalesce(col(source_col), F.lit("")) == F.col("q_source"))
    failed = (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))
    # One number over both sides of the join: a filter on it can't be pushed below, where the optimizer
    # would write the columns made above out into the expressions that run for each word.
    broken = F.col("q_base_failed").cast("int")
    for m in METRICS:
        broken = broken + F.coalesce((F.col(f"q_{m}") > F.col(f"q_max_{m}")).cast("int"), F.lit(0))
    return rows.withColumn("q_base_failed", failed).join(limits, keys, "left").withColumn("q_kept", broken == 0)


def keep_good(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; working columns step aside for the input's."""
    plain = {c: free_name(docs, f"row{i}") for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(col(c).alias(plain[c]) for c in docs.columns))
    passed = judge(renamed, plain[lang_col], plain[source_col], plain[text_col]).filter("q_kept")
    return passed.select(*(col(plain[c]).alias(c) for c in docs.columns))
