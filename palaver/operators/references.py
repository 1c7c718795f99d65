"""Mentions and quotes: who is referred to, and who refers to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.occurrences import FIRST_SEEN, appearance
from palaver.operators.select import NO_ID, NO_NAME, filter_unknown


def _times(
    df: DataFrame, column: str, item: str, unknown: str, by: Sequence[str]
) -> DataFrame:
    rows = df.select(*by, "post_num", F.posexplode(column).alias("pos", item))
    return (
        filter_unknown(rows, item, [unknown])
        .groupBy(*by, item)
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.min(appearance()).alias(FIRST_SEEN),
        )
    )


def times_mentioned(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each user id over all mention lists."""
    return _times(df, "mentioned_list", "user_id", NO_ID, by)


def times_quoted(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each user name over all quote lists."""
    return _times(df, "quoted_list", "user_name", NO_NAME, by)


def _posts_with(
    df: DataFrame, column: str, unknown: Sequence[str], by: Sequence[str]
) -> DataFrame:
    return (
        filter_unknown(df.filter(F.col(column) > 0), "author", unknown)
        .groupBy(*by, "author")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.min("post_num").alias("first_post"),
        )
    )


def messages_with_mention_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posts with at least one mention, of authors who have such posts."""
    return _posts_with(df, "mentions_count", [NO_ID, NO_NAME], by)


def messages_with_quote_by_author(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posts with at least one quote, of authors who have such posts."""
    return _posts_with(df, "quote_count", [NO_NAME], by)


def author_names(
    df: DataFrame, by: Sequence[str] = (), wanted: DataFrame | None = None
) -> DataFrame:
    """Name of every author id as given in its first post; nobody has no name.

    ``wanted`` holds (by…, author_id): posts of other authors are left out before
    anything is aggregated. Give it only where it is small enough for a broadcast.
    """
    known = df.filter(F.col("author_id") != NO_ID)
    if wanted is not None:
        known = known.join(F.broadcast(wanted), [*by, "author_id"], "left_semi")
    # Pairs first: that is a hash aggregate with a number in its buffer. Picking a
    # string directly would sort all posts; now only the few pairs are sorted.
    pairs = known.groupBy(*by, "author_id", "author").agg(
        F.min("post_num").alias("first_post")
    )
    return pairs.groupBy(*by, "author_id").agg(
        F.min(F.struct("first_post", "author")).getField("author").alias("name")
    )


def lookup_author_name(
    ids: DataFrame,
    posts: DataFrame,
    by: Sequence[str] = (),
    id_column: str = "user_id",
    few: bool = False,
) -> DataFrame:
    """Add ``name`` to ``ids``: the author's name, or the id if it never posted.

    With ``few`` — the caller knows a bound — only posts of these ids are aggregated.
    """
    wanted = ids.select(*by, F.col(id_column).alias("author_id")) if few else None
    names = author_names(posts, by, wanted).withColumnRenamed("author_id", id_column)
    joined = ids.join(names, [*by, id_column], "left")
    return joined.withColumn("name", F.coalesce("name", id_column))
