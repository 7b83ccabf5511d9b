"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.llm.html import extract_text
from screenflow.llm.importance import resample
from screenflow.llm.minmax import near_duplicates
from screenflow.llm.mixing import mix_sources
from screenflow.llm.packing import pack
from screenflow.llm.phrases import remove_passages
from screenflow.llm.quality import judge
from screenflow.llm.secrets import joined_spans, scan_secrets
from screenflow.llm.simhash import simhash_duplicates
from screenflow.llm.simplex import cluster_vectors
from screenflow.llm.suffix import remove_repeats
from screenflow.llm.topk import top_k
from screenflow.llm.urls import filter_urls, host, segment


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bit_sliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs).select("doc_id", *(F.col(f"q_{c}").alias(c) for c in counts))


def _hex_number(text, digits: int = 7):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list history over the hosts, domains and paths of ``pages``.

    The tables hold no lists, so keys, days and actions follow from a hash of the
    key: listed, taken off some weeks later, and for some listed again.
    """
    name = host(F.col("url"))
    urls = pages.select(name.alias("host"), F.substring_index(name, ".", -2).alias("domain"), F.concat_ws("/", name, segment(F.col("url"))).alias("path")).filter("host != ''")
    kinds = F.array(
        F.struct(F.lit("hosts").alias("list"), F.col("host").alias("key"), F.lit(4).alias("every")),
        F.struct(F.lit("domains").alias("list"), F.col("domain").alias("key"), F.lit(3).alias("every")),
        F.struct(F.lit("paths").alias("list"), F.col("path").alias("key"), F.lit(5).alias("every")),
    )
    listed = urls.select(F.inline(kinds)).distinct().withColumn("h", _hex_number(F.concat_ws(":", "list", "key"))).filter("h % every = 0")
    first, off = (F.col("h") / 8 % 200).cast("int"), (F.col("h") / 1600 % 90 + 1).cast("int")
    days = F.array(
        F.struct(first.alias("day"), F.lit("add").alias("action")),
        F.struct((first + off).alias("day"), F.lit("remove").alias("action")),
        F.struct((first + off + 30).alias("day"), F.when(F.col("h") % 2 == 0, "add").otherwise("remove").alias("action")),
    )
    return listed.select("key", "list", F.inline(days)).select("key", "list", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("dated"), "action")


def op3_url_list_join(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    judged = filter_urls(pages.withColumn("fetched_on", fetched), list_entries(pages))
    return judged.select("page_id", "url", "fetched_on", F.array_join("lists", ",").alias("lists"), "blocked")


def op4_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), context=2048, buckets=8, budget=65536)


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix_sources(docs, seed=1).select("doc_id", "source", "copy", "order_key", "text")


def op7_block_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_randomness_battery(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op9_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle_words=2)


def op10_phrase_automata(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_passages(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_pivot_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_duplicates(table(spark, folder, "documents"), shingle_words=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simplex_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "embeddings"), dims=64, scale=64, k=16, rounds=3, seed=1)


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"),
        max_words=1, buckets=10_000, percent=10, least_words=20, seed=2024,
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_bit_sliced_top_k, op2_quality_rules, op3_url_list_join, op4_length_buckets, op5_suffix_array_dedup,
        op6_poisson_mixing, op7_block_rules, op8_randomness_battery, op9_minmax_near_dedup, op10_phrase_automata,
        op11_pivot_simhash, op12_simplex_clusters, op13_importance_resampling,
    )
}
