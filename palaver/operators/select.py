"""Row selections. Conditions stay on bare columns so that they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.paging import POSTS_PER_PAGE

# Fixed values standing for nobody: an id and a name.
NO_ID = "0"
NO_NAME = ""


def check_one_range(pages: range | None, posts: range | None) -> None:
    if pages and posts:
        raise ValueError("give a page range or a post range, not both")


def in_range(value: Column, numbers: range) -> Column:
    """Membership in a Python range, step included."""
    low, high = min(numbers[0], numbers[-1]), max(numbers[0], numbers[-1])
    inside = value.between(low, high)
    step = abs(numbers.step)
    return inside if step == 1 else inside & ((value - low) % step == 0)


def filter_page_range(df: DataFrame, pages: range | None) -> DataFrame:
    """Pages of the range, step honoured. No range, or an empty one, keeps all."""
    return df.filter(in_range(F.col("page_num"), pages)) if pages else df


def filter_pages_of_posts(
    df: DataFrame, posts: range | None, posts_per_page: int | None = POSTS_PER_PAGE
) -> DataFrame:
    """Pages that can hold a post of the range; run it ahead of the extraction.

    All pages, where it is not known (None) how many posts a page holds.
    """
    if not posts or not posts_per_page:
        return df
    low, high = min(posts[0], posts[-1]), max(posts[0], posts[-1])
    return df.filter(
        F.col("page_num").between(F.ceil(F.lit(low) / posts_per_page), F.ceil(F.lit(high) / posts_per_page))
    )


def filter_post_range(df: DataFrame, posts: range | None) -> DataFrame:
    """Posts of the range, step honoured, whatever pages they stand on."""
    return df.filter(in_range(F.col("post_num"), posts)) if posts else df


def filter_page_span(df: DataFrame, pages: range | None) -> DataFrame:
    """Pages between the first and the last of the range; the step is ignored."""
    return df.filter(F.col("page_num").between(pages[0], pages[-1])) if pages else df


def filter_post_span(df: DataFrame, posts: range | None) -> DataFrame:
    return df.filter(F.col("post_num").between(posts[0], posts[-1])) if posts else df


def select_span(
    df: DataFrame, pages: range | None = None, posts: range | None = None
) -> DataFrame:
    """The part of a posts table that later reports are to look at."""
    check_one_range(pages, posts)
    return filter_post_span(filter_page_span(df, pages), posts)


def filter_author(df: DataFrame, author: str) -> DataFrame:
    return df.filter(F.col("author") == author)


def in_time_range(start: float, end: float) -> Column:
    return F.col("creation_ts").between(_instant(start), _instant(end))


def filter_time_range(df: DataFrame, start: float, end: float) -> DataFrame:
    """Posts between two Unix times, both inclusive."""
    return df.filter(in_time_range(start, end))


def filter_year(df: DataFrame, year: int) -> DataFrame:
    """Posts of a calendar year as read in each post's own offset.

    Parquet prunes on instants only, so the exact condition on local time comes
    with a wider one on the instant: no offset exceeds 18 hours.
    """
    local = F.col("creation_local")
    first = F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")
    after = F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz")
    margin = timedelta(hours=18)
    begin = datetime(year, 1, 1, tzinfo=timezone.utc) - margin
    until = datetime(year + 1, 1, 1, tzinfo=timezone.utc) + margin
    near = F.col("creation_ts").between(
        _instant(begin.timestamp()), _instant(until.timestamp())
    )
    return df.filter(near & (local >= first) & (local < after))


def filter_violations(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_rules_compliant"))


def having_min_messages(stats: DataFrame, n: int = 50) -> DataFrame:
    """Groups of at least ``n`` messages."""
    return stats.filter(F.col("messages") >= n)


def filter_unknown(
    df: DataFrame, column: str, unknown: Sequence[str] = (NO_ID, NO_NAME)
) -> DataFrame:
    """Drop the placeholders for nobody; NULL goes with them."""
    return df.filter(~F.col(column).isin(*unknown))


def _instant(seconds: float) -> Column:
    return F.timestamp_micros(F.lit(round(seconds * 1_000_000)).cast("bigint"))
