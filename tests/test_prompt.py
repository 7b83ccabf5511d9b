import hashlib
import warnings

import pytest
from pyspark.sql import functions as F

from screenflow.functions.strings import row_text
from screenflow.operators import prompt as p
from screenflow.spec import CLASSIFY, SCREEN, TEXT_COLS, USER_TEMPLATE, Settings

SCHEMA = (
    "ord bigint, url string, description string, transcript string, suggested_words string, "
    f"{SCREEN.truth_col} string, {CLASSIFY.truth_col} string, rationale string"
)
TRAIN = [
    (2, "b", "second", None, "w", "TRUE", "FALSE", "  "),
    (1, "a", "first", " t ", None, "TRUE", "TRUE", " as is "),
    (3, "c", " ", None, "", "FALSE", "FALSE", "left out"),
    (4, "d", None, "fourth", None, "FALSE", "TRUE", None),
]
SETTINGS = Settings("m", "m")


@pytest.fixture
def train(spark):
    return spark.createDataFrame(TRAIN, SCHEMA).repartition(4)


def test_examples_block_layout(spark, train):
    block = p.fewshot_pieces(train, CLASSIFY)
    text = p.collect_prompt(p.prompt_pieces(spark, "{examples}", block))
    assert text == (
        "Examples:\n\n\n"
        "Video metadata:\ndescription: first\ntranscript:  t \nLabel: TRUE\nRationale:  as is \n\n"
        "Video metadata:\ndescription: second\nsuggested_words: w\nLabel: FALSE\n\n"
        "Video metadata:\ntranscript: fourth\nLabel: TRUE\n"
    )


def test_screen_examples_have_no_rationale(spark, train):
    text = p.build_prompt(spark, SCREEN, SETTINGS, train)
    assert "Rationale" not in text and text.count("Label: ") == 3
    assert text.startswith(SCREEN.template.split("{examples}")[0])


def test_no_train_text_gives_an_empty_block(spark, train):
    block = p.fewshot_pieces(train.filter("url = 'c'"), CLASSIFY)
    assert block.isEmpty()
    assert p.collect_prompt(p.prompt_pieces(spark, "a{examples}b", block)) == "ab"


def test_own_template(spark, train):
    asked = Settings("m", "m", rationale=True)
    text = p.build_prompt(spark, CLASSIFY, asked, train, template="<{examples}|{examples}>")
    block = p.collect_prompt(p.prompt_pieces(spark, "{examples}", p.fewshot_pieces(train, CLASSIFY)))
    ending = "\n\nAlso provide a one-sentence rationale explaining your decision."
    assert text == f"<{block}|{block}>{ending}"


def test_template_without_a_slot_warns(spark, train):
    with pytest.warns(UserWarning, match="no examples slot"):
        assert p.build_prompt(spark, CLASSIFY, SETTINGS, train, template="fixed") == "fixed"
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        p.build_prompt(spark, CLASSIFY, SETTINGS, train.limit(0), template="fixed")


def test_size_is_known_before_the_text_is_built(spark, train):
    pieces = p.prompt_pieces(spark, SCREEN.template, p.fewshot_pieces(train, SCREEN))
    size = p.prompt_size(pieces).first()
    assert size["n_chars"] == len(p.collect_prompt(pieces)) and size["n_examples"] == 3
    with pytest.raises(ValueError, match="the limit is 100"):
        p.collect_prompt(pieces, max_chars=100)


def test_fingerprint():
    assert p.fingerprint("é") == hashlib.md5("é".encode()).hexdigest()[:8]


def test_messages_and_tokens(spark):
    rows = spark.createDataFrame(
        [("héllo 漢字", None, "w"), (None, None, None)],
        "description string, transcript string, suggested_words string",
    )
    text = row_text(rows.columns, TEXT_COLS)
    system = "sys"
    got = rows.select(
        text.alias("text"),
        p.chat_messages(text, system).alias("chat"),
        p.estimated_tokens(text, len(system)).alias("tokens"),
    ).collect()
    for r in got:
        assert [tuple(m) for m in r["chat"]] == [
            ("system", system), ("user", USER_TEMPLATE.replace("{text}", r["text"]))
        ]
        user_chars = len(USER_TEMPLATE) - len("{text}") + len(r["text"])
        assert r["tokens"] == (len(system) + user_chars) // 4


def test_oversize_uses_the_output_budget(spark):
    rows = spark.createDataFrame([("x" * 380,), ("x" * 390,)], "description string")
    text = row_text(rows.columns, TEXT_COLS)
    short = Settings("m", "m", context_limit=115)
    asked = Settings("m", "m", context_limit=115, rationale=True)
    assert short.output_budget() == 11 and asked.output_budget() == 100
    for settings in (short, asked):
        got = [r[0] for r in rows.select(p.oversize_label(text, 0, settings)).collect()]
        tokens = [(len("Video metadata:\n") + len("description: ") + n) // 4 for n in (380, 390)]
        assert got == [
            "TOO_LONG" if t + settings.output_budget() > 115 else None for t in tokens
        ]


def test_token_distribution_is_exact(spark):
    rows = spark.range(1000).selectExpr("repeat('x', cast(id as int)) as description")
    got = p.token_distribution(rows, F.col("description"), 0, 100).first()
    tokens = sorted((16 + n) // 4 for n in range(1000))
    assert got["n_rows"] == 1000 and got["max_tokens"] == tokens[-1]
    assert got["p50_tokens"] == (tokens[499] + tokens[500]) / 2
    assert got["over_limit"] == sum(t > 100 for t in tokens)
