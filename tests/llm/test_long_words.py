"""Word hashes of words longer than a block of bytes."""

import numpy as np

from screenflow.llm.minmax import near_duplicates
from screenflow.llm.phrases import word_units

HEAD = "字" * 100
SWAPPED = [HEAD + "一二三四" * 40 + "五六七八" * 40, HEAD + "五六七八" * 40 + "一二三四" * 40, "u" * 300 + "123456", "u" * 300 + "654321"]


def hashes(*texts):
    parts = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, parts)])
    return word_units(np.frombuffer(b"".join(parts), np.uint8), offsets)[0].tolist()


def test_order_in_long_words():
    blocks = ["a" * 256, "b" * 256, "c" * 256]
    words = [*SWAPPED, "".join(blocks), "".join(blocks[::-1]), "a" * 256 + "c" * 256 + "b" * 256, "a" * 256, "a" * 257, "a" * 512, "short"]
    assert len(set(hashes(" ".join(words)))) == len(words)
    assert hashes(" ".join(words)) == [h for w in words for h in hashes(w)] == hashes(*words)
    assert hashes(f" {words[0]}\n", "", f"x {words[0]}")[::2] == hashes(words[0]) * 2


def test_long_words_in_another_order_are_no_duplicates(spark):
    rows = [(i, f"{word} end") for i, word in enumerate([*SWAPPED, SWAPPED[0]])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=2).collect()
    kept = {r["doc_id"]: r[-1] for r in got}
    assert kept == {0: True, 1: True, 2: True, 3: True, 4: False}
