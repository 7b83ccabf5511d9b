import random

from pyspark.sql import functions as F

from screenflow.functions.strings import (
    WHITESPACE,
    first_two_lines,
    is_blank,
    nonblank,
    row_text,
    strip,
)


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_blank_match_python(spark):
    rng = random.Random(7)
    alphabet = list(WHITESPACE) + list("ab\u00e9\u6f22\u200b")
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b")
    )
    for r in rows.collect():
        assert r["s"] == r["t"].strip()
        assert r["b"] == (not r["t"].strip())


def test_first_two_lines_match_python(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = [f"a{b}b{b}c" for b in breaks] + ["one", "", " \n x \n\n y", "a\n\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", first_two_lines(F.col("t")).alias("lines")
    )
    for r in rows.collect():
        wanted = r["t"].strip().splitlines() or [""]
        assert r["lines"][:2] == wanted[:2]


def test_row_text_skips_null_blank_and_absent_but_keeps_edges(spark):
    rows = spark.createDataFrame(
        [(1, " hi ", None, "x\ny"), (2, "\u3000", "", "\t"), (3, None, "t", None)],
        "id int, description string, transcript string, suggested_words string",
    )
    cols = ["suggested_words", "description", "nothing", "transcript"]
    got = {r[0]: r[1] for r in rows.select("id", row_text(rows.columns, cols)).collect()}
    assert got == {1: "suggested_words: x\ny\ndescription:  hi ", 2: "", 3: "transcript: t"}
    assert rows.select(row_text(rows.columns, ["nothing"]).alias("t")).first()["t"] == ""


def test_nonblank_is_never_null(spark):
    rows = spark.createDataFrame([(None,), (" ",), ("a",)], "t string")
    assert [r[0] for r in rows.select(nonblank(F.col("t"))).collect()] == [False, False, True]
