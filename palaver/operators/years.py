"""Figures per calendar year, years without posts included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.times import year_of
from palaver.operators.gaps import fill_gaps
from palaver.operators.ranking import top_n, totals_of

def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", year_of(F.col("creation_local")))


def author_years(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """messages, words and first_post of each author in each year."""
    return (
        with_year(df)
        .groupBy(*by, "year", "author")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.sum(F.col("word_count").cast("bigint")).alias("words"),
            F.min("post_num").alias("first_post"),
        )
    )


def year_totals(
    stats: DataFrame, metric: str, by: Sequence[str] = ()
) -> DataFrame:
    """Total of a criterion in every calendar year, from ``author_years`` rows."""
    totals = totals_of(stats, metric, ("first_post",), [*by, "year"])
    return fill_gaps(totals, "year", ["total"], by)


def authors_per_year(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Different authors and posts in every calendar year.

    Authors are folded to one row each before they are counted, so a year with
    most of the posts is no heavier than the others.
    """
    counts = (
        author_years(df, by)
        .groupBy(*by, "year")
        .agg(F.count(F.lit(1)).alias("authors"), F.sum("messages").alias("messages"))
    )
    return fill_gaps(counts, "year", ["authors", "messages"], by)


def messages_per_author_per_year(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posts over authors; NULL in a year without posts."""
    ratio = F.try_divide(F.col("messages"), F.col("authors"))
    return authors_per_year(df, by).withColumn("messages_per_author", ratio)


def yearly_top_n(
    df: DataFrame, n: int = 10, criterion: str = "messages", by: Sequence[str] = ()
) -> DataFrame:
    """The n first authors of each year."""
    metric = metric_of(criterion)
    return top_n(
        author_years(df, by), metric, n, ("first_post", "author"), [*by, "year"]
    )


def metric_of(criterion: str) -> str:
    """Column a criterion stands for; anything but messages means words."""
    return "messages" if criterion == "messages" else "words"
