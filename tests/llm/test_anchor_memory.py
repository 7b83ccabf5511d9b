"""A batch's anchors are gathered and sent in parts, so a batch takes little more than its text."""

import tracemalloc

import numpy as np
import pyarrow as pa

from screenflow.llm import anchors
from screenflow.llm.suffix import RULE


def batch(n_rows, size, seed=1):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 256, size, np.uint8).tobytes() for _ in range(n_rows)]
    texts[-1] = texts[0]
    return pa.RecordBatch.from_arrays([pa.array(range(n_rows), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "body"])


def sent(rows):
    return sorted(tuple(r.values()) for out in anchors.find_pairs(RULE, 16)(iter([rows])) for r in out.to_pylist())


def test_pairs_sent_in_parts_are_the_same(monkeypatch):
    rows = batch(40, 500)
    whole = sent(rows)
    monkeypatch.setattr(anchors, "SENT", 7)
    assert sent(rows) == whole and {r[1] for r in whole} == {anchors.ASKED, anchors.KNOWN, anchors.TOLD}
    assert sent(batch(1, 10).slice(0, 0)) == []


def test_only_wanted_runs_are_gathered():
    data, offsets = anchors.binary_column(batch(5, 300).column("body"))
    every = anchors.batch_anchors(RULE, data, offsets)
    some = anchors.batch_anchors(RULE, data, offsets, (anchors.ROW, anchors.HASH), lambda row, hashes: hashes % np.uint64(3) == 0)
    kept = every[anchors.HASH] % np.uint64(3) == 0
    assert kept.any() and not kept.all()
    for column, got in zip((anchors.ROW, anchors.HASH), some, strict=True):
        assert got.tolist() == every[column][kept].tolist()


def test_memory_of_a_batch():
    rows = batch(400, 40_000)
    tracemalloc.start()
    for _ in anchors.find_pairs(RULE, 48)(iter([rows])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * 400 * 40_000
