"""Totals and per-author figures.

One aggregate serves every per-author figure: its map-side half folds all posts
of a prolific author inside each task, so only one row per author and task is
shuffled. Columns a caller does not use are pruned from it by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERALL = "Gesamt"  # fixed value


def _messages() -> Column:
    return F.count(F.lit(1)).alias("messages")


def _words() -> Column:
    return F.coalesce(F.sum(F.col("word_count").cast("bigint")), F.lit(0)).alias("words")


def total_messages(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_messages())


def total_words(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_words())


def words_per_message(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Words over messages; NULL without messages."""
    return _ratio(df.groupBy(*by).agg(_messages(), _words()))


def mean(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"))


def distinct_authors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact number of authors. Spark first groups by author, then counts."""
    return df.groupBy(*by).agg(F.count_distinct("author").alias("authors"))


def list_authors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every author once, in order of first appearance."""
    firsts = df.groupBy(*by, "author").agg(F.min("post_num").alias("first_post"))
    return firsts.orderBy(*by, "first_post", "author")


def span_bounds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last calendar year and Unix time."""
    return df.groupBy(*by).agg(
        F.year(F.min("creation_local")).alias("first_year"),
        F.year(F.max("creation_local")).alias("last_year"),
        F.unix_seconds(F.min("creation_ts")).alias("first_timestamp"),
        F.unix_seconds(F.max("creation_ts")).alias("last_timestamp"),
    )


def author_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """messages, words, violations and first_post of every author."""
    return df.groupBy(*by, "author").agg(
        _messages(),
        _words(),
        F.count_if(~F.col("is_rules_compliant")).alias("violations"),
        F.min("post_num").alias("first_post"),
    )


def messages_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return author_stats(df, by).select(*by, "author", "messages", "first_post")


def words_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return author_stats(df, by).select(*by, "author", "words", "first_post")


def words_per_message_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _ratio(author_stats(df, by)).select(
        *by, "author", "messages", "words", "words_per_message", "first_post"
    )


def violations_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return author_stats(df, by).select(*by, "author", "violations", "first_post")


def violation_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rate = F.col("violations") / F.col("messages")
    return author_stats(df, by).select(
        *by,
        "author",
        "messages",
        "violations",
        rate.alias("violation_rate"),
        "first_post",
    )


def violation_rate_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Violations over messages, lowest first."""
    return violation_rates(df, by).orderBy(*by, "violation_rate", "first_post", "author")


def overall_plus_groups(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Words per message of every author and, flagged, of all together.

    The grouping sets run over the per-author rows, not over the posts.
    """
    sums = (
        author_stats(df, by)
        .groupingSets([[*by, "author"], [*by]], *by, "author")
        .agg(
            (F.grouping("author") == 1).alias("is_overall"),
            F.sum("messages").alias("messages"),
            F.sum("words").alias("words"),
            F.min("first_post").alias("first_post"),
        )
    )
    label = F.when(F.col("is_overall"), F.lit(OVERALL)).otherwise(F.col("author"))
    return _ratio(sums).withColumn("author", label)


def _ratio(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "words_per_message", F.try_divide(F.col("words"), F.col("messages"))
    )
