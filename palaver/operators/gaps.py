"""Calendar rows nobody posted in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_gaps(
    counts: DataFrame, key: str, zeros: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add the missing years or days between the first and the last, with zeros.

    Each row reaches up to the next one present. ``counts`` is aggregated by the
    calendar column ``key``: the window sees one row per year or day, not posts.
    """
    following = F.lead(key).over(W.partitionBy(*by).orderBy(key))
    reach = counts.withColumn("_last", F.coalesce(following - 1, F.col(key)))
    filled = reach.withColumn("_key", F.explode(F.sequence(F.col(key), F.col("_last"))))
    present = F.col("_key") == F.col(key)
    others = [c for c in counts.columns if c not in (*by, key, *zeros)]
    return filled.select(
        *by,
        F.col("_key").alias(key),
        *[F.when(present, F.col(c)).otherwise(F.lit(0)).alias(c) for c in zeros],
        *[F.when(present, F.col(c)).alias(c) for c in others],
    )
