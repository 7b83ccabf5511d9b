import math

import pytest
from pyspark.sql import functions as F

from screenflow.functions.replies import parse_label, parse_reply, prob_true

LABEL_CASES = [
    ("TRUE", "TRUE"),
    ("  false\n", "FALSE"),
    ("\u3000True ", "TRUE"),
    ("TRUENESS", "TRUE"),
    ("The answer is false.", "FALSE"),
    ("untrue", "UNKNOWN"),
    ("answer:\nTRUE", "UNKNOWN"),
    ("answer:\tTRUE", "UNKNOWN"),
    ("not FALSE but TRUE", "FALSE"),
    ("TRUE, not FALSE", "TRUE"),
    ("", "UNKNOWN"),
    (None, "UNKNOWN"),
]


def test_parse_label(spark):
    rows = spark.createDataFrame(LABEL_CASES, "raw string, want string")
    for r in rows.select("raw", "want", parse_label(F.col("raw")).alias("got")).collect():
        assert r["got"] == r["want"], r["raw"]


def test_label_set_is_a_parameter_and_exact_match_wins(spark):
    labels = ["no", "no comment", "yes"]
    rows = spark.createDataFrame([("No comment",), ("well no",), ("TRUE",)], "raw string")
    got = [r[0] for r in rows.select(parse_label(F.col("raw"), labels)).collect()]
    assert got == ["NO COMMENT", "NO", "UNKNOWN"]


REPLY_CASES = [
    ('{"label": "TRUE", "rationale": " because "}', "TRUE", "because"),
    ('{"label": "FALSE", "rationale": "  "}', "FALSE", None),
    ('{"label": true, "rationale": "r"}', "TRUE", "r"),
    ('{"label": "TRUE"}', "TRUE", None),
    ('{"rationale": "only"}', "UNKNOWN", "only"),
    ('{"label": "maybe false", "rationale": "r"}', "FALSE", "r"),
    ("{}", "UNKNOWN", None),
    ('  {"label": "TRUE", "rationale": "r"}\n', "TRUE", "r"),
    ("{'label': 'TRUE', 'rationale': 'r'}", "UNKNOWN", None),
    ('{"label": "TRUE", "rationale": "r"} trailing', "UNKNOWN", None),
    ("TRUE\n it names a condition \nmore", "TRUE", "it names a condition"),
    ("FALSE\r\nsecond", "FALSE", "second"),
    ("TRUE\x1csecond", "TRUE", "second"),
    ("TRUE\n\nthird", "TRUE", ""),
    ("TRUE", "TRUE", None),
    ("", "UNKNOWN", None),
    ("[1]", "UNKNOWN", None),
    ('"TRUE"', "UNKNOWN", None),
    ("null", "UNKNOWN", None),
]


@pytest.mark.parametrize("rationale", [True, False])
def test_parse_reply(spark, rationale):
    rows = spark.createDataFrame(REPLY_CASES, "raw string, label string, reason string")
    got = rows.select("*", parse_reply(F.col("raw"), rationale=rationale).alias("got")).collect()
    for r in got:
        if rationale:
            assert (r["got"]["label"], r["got"]["rationale"]) == (r["label"], r["reason"]), r["raw"]
        else:
            assert r["got"]["rationale"] is None


def test_prob_true(spark):
    schema = "id int, tokens array<struct<token:string,logprob:double>>"
    rows = spark.createDataFrame(
        [
            (1, [("FALSE", -0.1), (" true", -2.0), ("TRUE", -3.0)]),
            (2, [("FALSE", -0.1)]),
            (3, []),
            (4, None),
        ],
        schema,
    )
    got = {r[0]: r[1] for r in rows.select("id", prob_true(F.col("tokens"))).collect()}
    assert got[1] == pytest.approx(math.exp(-3.0))
    assert got[2] is None and got[3] is None and got[4] is None
