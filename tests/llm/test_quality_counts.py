"""The base counts of the quality rules against a plain count."""

from collections import Counter

from screenflow.llm.queries import QUERIES
from tests.llm.brute import WORD


def plain(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def test_base_counts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_quality_rules"](spark, data).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(plain(*r) for r in docs)
    assert not any(r["kept"] and r["base_failed"] for r in got)
