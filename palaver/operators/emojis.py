"""Emoji maps: explode each map once, aggregate, then rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.maps import sum_map_values
from palaver.operators.occurrences import FIRST_SEEN, appearance

MAP = "emoji_frequency_mapping"


def emoji_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per post and emoji: author, emoji, n and its first-seen position."""
    return df.select(
        *by, "author", "post_num", F.posexplode(MAP).alias("pos", "emoji", "n")
    ).select(*by, "author", "emoji", "n", appearance().alias(FIRST_SEEN))


def total_emojis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.coalesce(F.sum(F.col("emoji_count").cast("bigint")), F.lit(0))
    return df.groupBy(*by).agg(total.alias("total"))


def emoji_frequency(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Uses of every emoji and where it was first seen."""
    return (
        emoji_rows(df, by)
        .groupBy(*by, "emoji")
        .agg(F.sum("n").alias("count"), F.min(FIRST_SEEN).alias(FIRST_SEEN))
    )


def used_emojis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every emoji once, in order of first appearance."""
    firsts = emoji_rows(df, by).groupBy(*by, "emoji").agg(
        F.min(FIRST_SEEN).alias(FIRST_SEEN)
    )
    return firsts.orderBy(*by, FIRST_SEEN, "emoji")


def emojis_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Emojis each author used, authors without any included."""
    return df.groupBy(*by, "author").agg(
        F.sum(sum_map_values(F.col(MAP))).alias("emojis"),
        F.min("post_num").alias("first_post"),
    )


def emoji_counts_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The merged map of every author, one row per author and emoji."""
    return (
        emoji_rows(df, by)
        .groupBy(*by, "author", "emoji")
        .agg(F.sum("n").alias("n"), F.min(FIRST_SEEN).alias(FIRST_SEEN))
    )


def shortcode_to_emoji(
    df: DataFrame, names: DataFrame, column: str = "emoji"
) -> DataFrame:
    """Replace ``:name:`` codes by the symbol in ``names(shortcode, symbol)``.

    Codes without an entry stay. Call it on aggregated rows; Spark broadcasts
    ``names`` only if its measured size allows.
    """
    symbols = names.select(F.col("shortcode").alias(column), "symbol")
    joined = df.join(symbols, column, "left")
    return joined.withColumn(column, F.coalesce("symbol", column)).select(*df.columns)
