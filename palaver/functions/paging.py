"""Page arithmetic and page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSTS_PER_PAGE = 20  # fixed value


def page_of_post(post_num: Column) -> Column:
    return F.ceil(post_num / POSTS_PER_PAGE)


def first_post_of_page(page_num: Column) -> Column:
    return page_num * POSTS_PER_PAGE - (POSTS_PER_PAGE - 1)


def last_post_of_page(page_num: Column) -> Column:
    return page_num * POSTS_PER_PAGE


def page_from_url(url: Column) -> Column:
    """1 for an address ending in ``/``, else its trailing number, else NULL."""
    digits = F.nullif(F.regexp_extract(url, r"(?<!\d)(\d+)$", 1), F.lit(""))
    return F.when(url.endswith("/"), F.lit(1).cast("bigint")).otherwise(
        digits.try_cast("bigint")
    )


def url_for_page(base_url: Column, page_num: Column) -> Column:
    """Address of a page; ``base_url`` ends in a slash."""
    return F.concat(base_url, F.lit("page-"), page_num.cast("string"), F.lit("/"))
