"""Top n, shares and the remainder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REST = "Rest"  # fixed value
SALTS = 64


def order_of(metric: str, ties: Sequence[str]) -> list[Column]:
    """Metric descending; equal values by first appearance, then by name."""
    return [F.col(metric).desc(), *(F.col(t).asc() for t in ties)]


def top_n(
    stats: DataFrame, metric: str, n: int, ties: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The first n rows by ``metric`` — of all, or of each ``by`` group.

    ``stats`` must hold aggregated rows. Without groups each task keeps n rows
    and one merge picks among them. With groups a ``rank`` column is added.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    order = order_of(metric, ties)
    if not by:
        return stats.orderBy(*order).limit(n)
    # Up to this n Spark cuts each group to n rows before it shuffles, so a hot
    # group costs no more than any other. Beyond it, split the groups ourselves:
    # no row outside the first n of its slice can be in the first n of its group.
    threshold = int(
        stats.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if n > threshold:
        slice_of = F.pmod(F.xxhash64(*ties), F.lit(SALTS))
        sliced = stats.withColumn("_slice", slice_of)
        stats = _first_rows(sliced, [*by, "_slice"], order, n).drop("_slice", "rank")
    return _first_rows(stats, by, order, n)


def _first_rows(
    df: DataFrame, by: Sequence[str], order: list[Column], n: int
) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def share_of_total(
    stats: DataFrame,
    totals: DataFrame,
    metric: str,
    by: Sequence[str] = (),
    scale: float = 1.0,
) -> DataFrame:
    """Add ``share`` = metric / total of the row's group (of everything without
    groups). ``totals`` holds the column ``total`` and one row per group.
    """
    if by:
        joined, total = stats.join(totals, list(by)), F.col("total")
    else:
        joined, total = stats, totals.select("total").scalar()
    share = F.try_divide(F.col(metric), total) * scale
    return joined.withColumn("share", share).drop("total")


def totals_of(
    stats: DataFrame, metric: str, ties: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``total`` of each group, and when the group first appeared.

    Taken from the aggregated rows. Asking for the first appearance as well makes
    this read the very columns a ranking reads, so Spark shuffles them once.
    """
    return stats.groupBy(*by).agg(
        F.sum(metric).alias("total"), F.min(ties[0]).alias(ties[0])
    )


def top_n_with_rest(
    stats: DataFrame,
    totals: DataFrame,
    metric: str,
    name: str,
    n: int,
    ties: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Shares of the first n rows and, flagged ``is_rest``, of all the others.

    ``totals`` comes from ``totals_of``; every group in it gets its remainder
    row, even without a top row. In groups the first n carry their ``rank``.
    """
    top = top_n(stats, metric, n, ties, by)
    ranks = ["rank"] if by else []
    rows = totals.select(
        *by,
        F.lit(REST).alias(name),
        F.coalesce("total", F.lit(0)).alias("amount"),
        F.lit(True).alias("is_rest"),
        ties[0],
        *[F.lit(None).cast("int").alias(c) for c in ranks],
    ).unionByName(
        top.select(
            *by, name, F.col(metric).alias("amount"), F.lit(False).alias("is_rest"), ties[0], *ranks
        )
    )
    # A union instead of joins: both sides then read the very same aggregate, and
    # a window over the n + 1 rows left of each group has all that is needed.
    group, is_rest, amount = W.partitionBy(*by), F.col("is_rest"), F.col("amount")
    total = F.sum(F.when(is_rest, amount)).over(group)
    shown = F.coalesce(F.sum(F.when(~is_rest, amount)).over(group), F.lit(0))
    rows = rows.select("*", total.alias("_total"), shown.alias("_shown"))
    rows = rows.withColumn("amount", F.when(is_rest, amount - F.col("_shown")).otherwise(amount))
    share = F.try_divide(F.col("amount"), F.col("_total"))
    return rows.withColumn(
        "share", F.when(is_rest, F.coalesce(share, F.lit(1.0))).otherwise(share)
    ).drop("_total", "_shown")
