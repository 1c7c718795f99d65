"""Character counts over the words of all posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüß"  # fixed value
MODES = ("count_all", "count_first", "count_last")  # fixed value


def _count(chars: DataFrame, by: Sequence[str]) -> DataFrame:
    return chars.groupBy(*by, "char").agg(
        F.count(F.lit(1)).alias("count"), F.min("post_num").alias("first_post")
    )


def char_counts_all(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every character of every word; the words of a post are exploded as one."""
    letters = F.split(F.array_join("words", ""), "")
    rows = df.select(*by, "post_num", F.explode(letters).alias("char"))
    return _count(rows.filter(F.col("char") != ""), by)


def _one_of_each(df: DataFrame, start: int, by: Sequence[str]) -> DataFrame:
    # Cut inside the array: of a plain array column Spark would first ask whether it
    # is empty, and split a post's text once more for that.
    chars = F.transform("words", lambda word: F.substring(word, start, 1))
    return _count(df.select(*by, "post_num", F.explode(chars).alias("char")), by)


def char_counts_first(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _one_of_each(df, 1, by)


def char_counts_last(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _one_of_each(df, -1, by)


def char_counts(df: DataFrame, mode: str, by: Sequence[str] = ()) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    count = dict(zip(MODES, (char_counts_all, char_counts_first, char_counts_last)))
    return count[mode](df, by)


def filter_chars(
    counts: DataFrame, chars: str | None = ALPHABET, case_insensitive: bool = True
) -> DataFrame:
    """Keep the given characters; none given keeps all."""
    if not chars:
        return counts
    if case_insensitive:
        return counts.filter(F.lower("char").isin(*chars.lower()))
    return counts.filter(F.col("char").isin(*chars))


def fold_case(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, F.lower("char").alias("char")).agg(
        F.sum("count").alias("count"), F.min("first_post").alias("first_post")
    )
