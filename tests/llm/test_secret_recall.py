"""Recall of the secret scan by encoding, length and dilution."""

import numpy as np
import pytest

from screenflow.llm import secrets
from screenflow.llm.secrets import ALPHABETS, scan_secrets

WORDS = "report year summary of the annual market price index file version data table user name list final draft letter".split()


def drawn(rng, alphabet, length):
    return "".join(rng.choice(list(alphabet), length))


def plain_token(rng, kind, length):
    """An ordinary token: words and a number, or for hex a number and a word of its letters."""
    if kind == "hex":
        return (str(rng.integers(10**6, 10**7)) * 10)[: length - 6] + str(rng.choice(["FACADE", "DECADE", "DEFACE"]))
    words = "".join(str(w).capitalize() for w in rng.choice(WORDS, length // 3))[: length - 4]
    return (words if kind == "base64" else words.upper()) + str(rng.choice(["2236", "2457", "2342"]))


def found(spark, tokens):
    got = scan_secrets(spark.createDataFrame(list(enumerate(tokens)), "doc_id bigint, text string"))
    return {r["doc_id"] for r in got.collect() if any(s["kind"] == "random" for s in r["spans"])}


@pytest.mark.parametrize(("kind", "length", "least"), [
    ("base32", 20, 0.6), ("base32", 32, 0.9), ("base32", 52, 0.98), ("hex", 20, 0.3), ("hex", 32, 0.7), ("hex", 64, 0.98),
    ("base64", 20, 0.7), ("base64", 24, 0.8), ("base64", 32, 0.98),
])
def test_recall(spark, kind, length, least):
    rng = np.random.default_rng(length)
    alphabet = ALPHABETS[kind].upper() if kind == "hex" else ALPHABETS[kind][:62]
    secrets = [drawn(rng, alphabet, length) for _ in range(50)]
    assert len(found(spark, secrets)) >= least * 50
    diluted = secrets + [plain_token(rng, kind, length) for _ in range(4950)]
    got = found(spark, diluted)
    assert sum(i < 50 for i in got) >= least * 50
    assert sum(i >= 50 for i in got) <= 2


@pytest.mark.parametrize(("alphabet", "length", "least"), [
    (ALPHABETS["base32"].lower(), 20, 0.8), (ALPHABETS["base36"], 24, 0.8), (ALPHABETS["base36"].lower(), 24, 0.8),
    (ALPHABETS["base32"][:26], 32, 0.6), (ALPHABETS["base64"][:52], 32, 0.9), (ALPHABETS["base64"][:62], 16, 0.8), (ALPHABETS["base64"][:62], 12, 0.6),
])
def test_all_alphabets_and_lengths_are_tested(spark, alphabet, length, least):
    rng = np.random.default_rng(length)
    assert len(found(spark, [drawn(rng, alphabet, length) for _ in range(50)])) >= least * 50


def test_separators_and_plain_words(spark):
    rng = np.random.default_rng(1)
    uuids = ["-".join(drawn(rng, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)) for _ in range(50)]
    assert len(found(spark, uuids)) >= 45
    prose = " ".join(WORDS) * 20 + " 2024-01-15 555-123-4567 --- /usr/share/doc Facade DECADE 3rd x2 https://example.com/2024/summary-of-prices"
    assert not found(spark, [prose])
    base = "0123456789abcdef01 " * 50 + "x7Kq2mVt9LzR4wPb8NcY"
    assert len(found(spark, [base])) == 1


CODE_WORDS = "get set user name file data list item node type size path make read load send form view main loop test code base unit time hash map key id url api".split()


def ordinary_names(rng, n):
    """Names that programs and catalogues hold: camel case of short words, part numbers, versions, constants."""
    def words(k):
        return [str(w) for w in rng.choice(CODE_WORDS, k)]

    def group():
        return drawn(rng, "ABCDEFGHJKLMNPQRSTUVWXYZ", 2) + drawn(rng, "0123456789", 1)

    kinds = [
        lambda: (w := words(6))[0] + "".join(x.capitalize() for x in w[1:]),
        lambda: "".join(x.capitalize() for x in words(7)),
        lambda: "-".join(["SKU", *(group() for _ in range(4))]),
        lambda: "-".join(group() + drawn(rng, "0123456789", 1) for _ in range(5)),
        lambda: "_".join(words(5)).upper(),
        lambda: f"{words(1)[0]}-{rng.integers(1, 30)}-{rng.integers(0, 20)}-rc{rng.integers(1, 9)}-build{rng.integers(1000, 9999)}",
    ]
    return [kinds[i % len(kinds)]() for i in range(n)]


def test_ordinary_names_are_no_secrets(spark):
    rng = np.random.default_rng(12)
    assert len(found(spark, ordinary_names(rng, 3000))) <= 3
    assert not found(spark, ["SKU-XJ9-QZ7-KW3-VP8 getUserNameFromDataList XMLHttpRequestFactoryBean"])
    keys = [drawn(rng, ALPHABETS["base64"][:62], 32) for _ in range(50)]
    got = found(spark, keys + ordinary_names(rng, 3000))
    assert sum(i < 50 for i in got) >= 48 and sum(i >= 50 for i in got) <= 2


def rare(rng, n):
    return "".join(rng.choice(list("QWXZJKVY"), n))


@pytest.mark.parametrize("shape", ["alternating", "repeated block", "zigzag", "few symbols"])
def test_each_test_of_the_battery_rejects_what_letters_alone_do_not(monkeypatch, shape):
    """Tokens whose symbols fit no ordinary token, but whose order or balance is not random."""
    rng = np.random.default_rng(2)
    make = {
        "alternating": lambda: "".join(rare(rng, 1) + drawn(rng, "0123456789", 1) for _ in range(12)),
        "repeated block": lambda: drawn(rng, ALPHABETS["base36"], 8) * 4,
        "zigzag": lambda: "".join(drawn(rng, "08BFGH", 1) + drawn(rng, "QVWXYZ", 1) for _ in range(14)),
        "few symbols": lambda: drawn(rng, "QZ7X9", 32),
    }[shape]
    tokens = [make() for _ in range(200)]
    kept = [t for t in tokens if secrets.judged(t)[1]]
    assert len(kept) <= 4
    monkeypatch.setattr(secrets, "battery", lambda *_: 1.0)
    monkeypatch.setattr(secrets, "pattern_runs", lambda *_: 1.0)
    assert len([t for t in tokens if secrets.judged(t)[1]]) >= 150


def test_uniform_tokens_pass_the_battery():
    rng = np.random.default_rng(9)
    for kind, length in (("hex", 32), ("base32", 32), ("base36", 24), ("base64", 20), ("base64", 64)):
        passed = [secrets.battery(np.array([secrets.PLACES[kind][c] for c in drawn(rng, ALPHABETS[kind], length)]), len(ALPHABETS[kind])) for _ in range(300)]
        assert sum(p < secrets.BATTERY_LEVEL for p in passed) <= 4, kind


def test_base_spans_of_the_given_table_restated(spark, data):
    """The three fixed kinds once more, character by character."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")

    def assigned(text):
        out, at = [], 0
        while at < len(text):
            end = None
            for name in names:
                if text[at : at + len(name)].translate(LOWER) == name:
                    k = at + len(name)
                    k += text[k : k + 1] in ("'", '"') and bool(text[k : k + 1])
                    while text[k : k + 1] == " ":
                        k += 1
                    if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                        continue
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"') and bool(text[k : k + 1])
                    start = k
                    while text[k : k + 1] and text[k] in value:
                        k += 1
                    if k > start:
                        end = (k, k - start)
                        break
            if end:
                out += [("assign", at, end[0])] if end[1] >= 12 else []
                at = end[0]
            else:
                at += 1
        return out

    def runs(text, kind, first, symbols, least):
        out, at = [], 0
        while at < len(text):
            if text.startswith(first, at) and text[at + len(first) : at + len(first) + 1] in symbols and text[at + len(first) : at + len(first) + 1]:
                k = at + len(first)
                while k < len(text) and text[k] in symbols:
                    k += 1
                out += [(kind, at, k)] if k - at >= least else []
                at = k
            else:
                at += 1
        return out

    capitals = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in scan_secrets(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    for doc, text in texts.items():
        want = assigned(text) + runs(text, "access", "AKIA", capitals, 18) + runs(text, "hex", "", set("0123456789abcdef"), 16)
        order = {"assign": 0, "access": 1, "hex": 2}
        assert got[doc] == sorted(want, key=lambda s: (s[1], order[s[0]])), doc
    assert any(got.values())


LOWER = {c: c + 32 for c in range(65, 91)}
