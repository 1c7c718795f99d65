"""Which pages of a thread are to be fetched next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontier_pages(
    known: DataFrame,
    last_pages: DataFrame,
    by: Sequence[str] = ("thread_id",),
    fill_gaps: bool = False,
) -> DataFrame:
    """Pages after the newest known one, and that one again as it may have grown.

    ``known`` holds (by…, page_num), ``last_pages`` (by…, last_page). With
    ``fill_gaps`` earlier pages that were never stored are listed too. A thread
    of which nothing is known is listed whole.
    """
    newest = known.groupBy(*by).agg(F.max("page_num").alias("newest"))
    spans = last_pages.join(newest, list(by), "left")
    start = F.lit(1) if fill_gaps else F.coalesce("newest", F.lit(1))
    pages = spans.filter(start <= F.col("last_page")).select(
        *by, "newest", F.explode(F.sequence(start, F.col("last_page"))).alias("page_num")
    )
    if fill_gaps:
        # The newest page is known, yet never matches, so it stays in the list.
        a, b = pages.alias("a"), known.alias("b")
        same = F.col("a.page_num") != F.col("a.newest")
        for c in (*by, "page_num"):
            same &= F.col(f"a.{c}") == F.col(f"b.{c}")
        pages = a.join(b, same, "left_anti")
    return pages.select(*by, "page_num")
