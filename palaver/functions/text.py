"""Text rules as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters that end a sentence or separate words.
PUNCTUATION = ".?!\"„“‚‘»«‹›,;:'’–—‐-·/()[]<>{}…☞‽¡¿⸘、"
# Invisible characters stripped from a post after ordinary white space.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5 "
# White space as a string strip sees it: the Unicode property White_Space and
# the four information separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RULE_NAMES = ("word_count", "first_letter", "punctuation")
MIN_WORDS = 5
# ----------------------------------------------------------------------------


def char_class(chars: str) -> str:
    """The inside of a regex character class, valid for Java and RE2 alike."""
    return "".join("\\" + c if c in "\\[]^-&" else c for c in chars)


@cache
def emoji_class() -> str:
    """Code points that are an emoji on their own, as the inside of a class.

    That is the Unicode property Emoji without the ASCII key-cap bases and the
    regional indicators, which only form emojis in sequences.
    """
    import regex

    is_emoji = regex.compile(r"\p{Emoji}")
    skipped = {*map(ord, "0123456789#*"), *range(0x1F1E6, 0x1F200)}
    runs: list[list[int]] = []
    for code in range(0x20000):
        if code in skipped or not is_emoji.match(chr(code)):
            continue
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


# Intersecting with \W first lets the matcher dismiss a letter with one test
# instead of trying every separator; no separator is a word character.
SEPARATORS = rf"(?U)[\W&&[\s{char_class(PUNCTUATION)}]]+"
WORD_CHAR = r"(?U)\w"
FIRST_LETTER_IS_UPPER = r"^\P{L}*+\p{Lu}"


def split_words(text: Column) -> Column:
    """Pieces between separators that hold at least one word character."""
    return F.filter(F.split(text, SEPARATORS), lambda piece: piece.rlike(WORD_CHAR))


def word_count(words: Column) -> Column:
    return F.size(words)


def strip_whitespace(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_content(text: Column) -> Column:
    """Strip white space, then the invisible characters."""
    return F.btrim(strip_whitespace(text), F.lit(INVISIBLE))


def rule_word_count(stripped: Column, n_words: Column) -> Column:
    return (stripped != "") & (n_words >= MIN_WORDS)


def rule_first_letter(stripped: Column) -> Column:
    """The first letter exists and is a capital."""
    return stripped.rlike(FIRST_LETTER_IS_UPPER)


def rule_punctuation(stripped: Column) -> Column:
    """The last character is punctuation, a backslash or an emoji."""
    allowed = char_class(PUNCTUATION + "\\") + emoji_class()
    return F.substring(stripped, -1, 1).rlike(f"^[{allowed}]$")


def rulebreak_reasons(stripped: Column, n_words: Column) -> Column:
    """Names of the broken rules, in the order of ``RULE_NAMES``."""
    kept = (
        rule_word_count(stripped, n_words),
        rule_first_letter(stripped),
        rule_punctuation(stripped),
    )
    return F.array_compact(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in zip(RULE_NAMES, kept)])
    )


def is_rules_compliant(reasons: Column) -> Column:
    return F.size(reasons) == 0


def with_text_columns(df: DataFrame) -> DataFrame:
    """Add words, word_count and the rule columns to rows holding ``content``.

    Each step is its own projection so that the split runs once per row and a
    query that reads none of these columns pays for none of them.
    """
    return (
        df.withColumn("words", split_words(F.col("content")))
        .withColumn("word_count", word_count(F.col("words")))
        .withColumn("_stripped", strip_content(F.col("content")))
        .withColumn(
            "rulebreak_reasons", rulebreak_reasons(F.col("_stripped"), F.col("word_count"))
        )
        .withColumn("is_rules_compliant", is_rules_compliant(F.col("rulebreak_reasons")))
        .drop("_stripped")
    )
