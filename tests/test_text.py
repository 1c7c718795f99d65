"""Word splitting and posting rules, the special cases included."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.functions.paging import page_from_url, page_of_post


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "given, words",
    [
        ("two-worded", ["two", "worded"]),
        ('not.one"word', ["not", "one", "word"]),
        ("", []),
        ("  ... !? ", []),
        ("a\\b c", ["a\\b", "c"]),
        ("=== x == y1_", ["x", "y1_"]),
        ("Grüße, Ärger ß", ["Grüße", "Ärger", "ß"]),
        ("a\x1cb", ["a\x1cb"]),
        ("x́y z", ["x́y", "z"]),
        ("„Zitat“ – …☞ende", ["Zitat", "ende"]),
        ("\U0001f600 hi\U0001f600", ["hi\U0001f600"]),
        ("数字、漢字", ["数字", "漢字"]),
    ],
)
def test_split_words(spark, given, words):
    assert one(spark, text.split_words, given) == words


def test_strip_is_python_strip(spark):
    for space in text.WHITESPACE:
        assert one(spark, text.strip_whitespace, f"{space}a{space}b{space}") == f"a{space}b"
    assert one(spark, text.strip_whitespace, "​a​") == "​a​"
    assert "".join(c for c in map(chr, range(0x3001)) if c.isspace()) == "".join(
        sorted(text.WHITESPACE)
    )


def test_strip_content_strips_twice(spark):
    assert one(spark, text.strip_content, " ͏ᅟHi ឴ ") == "Hi"
    # The second pass knows the blank but no other white space.
    assert one(spark, text.strip_content, "͏\tHi") == "\tHi"


def reasons(spark, content):
    df = text.with_text_columns(spark.createDataFrame([(content,)], "content string"))
    return df.first().rulebreak_reasons


@pytest.mark.parametrize(
    "content, broken",
    [
        ("", ["word_count", "first_letter", "punctuation"]),
        (" ͏ ", ["word_count", "first_letter", "punctuation"]),
        ("Das sind genau fünf Wörter.", []),
        ("Das sind nur vier.", ["word_count"]),
        ("das sind genau fünf Wörter.", ["first_letter"]),
        ("1 2 3 4 5 !", ["first_letter"]),
        ("5 Äpfel sind genau fünf Wörter?", []),
        ("Das sind genau fünf Wörter", ["punctuation"]),
        ("Das sind genau fünf Wörter\\", []),
        ("Das sind genau fünf Wörter \U0001f600", []),
        ("Das sind genau fünf Wörter ❤", []),
        ("Das sind genau fünf Wörter ❤️", ["punctuation"]),
        ("Das sind genau fünf Wörter 5", ["punctuation"]),
        ("Das sind genau fünf Wörter #", ["punctuation"]),
        ("Das sind genau fünf Wörter \U0001f1e9", ["punctuation"]),
        ("Das sind genau fünf Wörter.឵", []),
        ("ǅaz sind genau fünf Wörter.", ["first_letter"]),
    ],
)
def test_rules(spark, content, broken):
    assert reasons(spark, content) == broken


def test_letters_and_separators_agree_with_unicode(spark):
    chars = [
        c
        for c in map(chr, range(1, 0x2100))
        if unicodedata.category(c) not in ("Cn", "Cs")
    ]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    rows = df.select(
        "c", text.rule_first_letter(F.col("c")).alias("capital")
    ).collect()
    wrong = [r.c for r in rows if r.capital != (unicodedata.category(r.c) == "Lu")]
    assert wrong == []


@pytest.mark.parametrize(
    "url, page",
    [
        ("https://f.de/t.1/", 1),
        ("https://f.de/t.1/page-12/", 1),
        ("https://f.de/t.1/page-12", 12),
        ("https://f.de/t.1/page-0012", 12),
        ("https://f.de/t", None),
    ],
)
def test_page_from_url(spark, url, page):
    assert one(spark, page_from_url, url) == page


@pytest.mark.parametrize("post, page", [(1, 1), (20, 1), (21, 2), (40, 2), (41, 3)])
def test_page_of_post(spark, post, page):
    assert one(spark, page_of_post, post, "long") == page
