"""Printable reports as BBCode tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.occurrences import FIRST_SEEN
from palaver.operators.ranking import order_of
from palaver.plans.reports import report

# --- fixed values -----------------------------------------------------------
AUTHOR_HEADINGS = {
    "author": "Spieler",
    "messages": "Anzahl Beiträge",
    "violations": "Anzahl nicht regelkonformer Beiträge",
    "violation_pct": "Prozentanzahl nicht regelkonformer Beiträge",
}
EMOJI_HEADINGS = {"emoji": "Emoji", "count": "Anzahl"}
PERCENT_COLUMNS = ("violation_pct",)
# ----------------------------------------------------------------------------


def by_messages() -> list[Column]:
    return order_of("messages", ("first_post", "author"))


def by_rate() -> list[Column]:
    return [F.col(c).asc() for c in ("violation_rate", "first_post", "author")]


def by_count() -> list[Column]:
    return order_of("count", (FIRST_SEEN, "emoji"))


PRINTABLE = {
    "author_table": (AUTHOR_HEADINGS, by_messages),
    "violation_table": (AUTHOR_HEADINGS, by_rate),
    "emoji_table": (EMOJI_HEADINGS, by_count),
}


def printable(name: str, posts: DataFrame, **options) -> DataFrame:
    """A report by name as the lines of a table. A table covers one selection of posts, so there is no ``by``."""
    if name not in PRINTABLE:
        raise ValueError(f"{name} is no table to print; there are {', '.join(PRINTABLE)}")
    if options.get("by"):
        raise ValueError("filter the posts of one group and print its table")
    headings, order = PRINTABLE[name]
    return markup_table(report(name, posts, **options), headings, order())


def _cell(value: Column) -> Column:
    return F.concat(F.lit("[TD]"), value, F.lit("[/TD]"))


def _row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("[TR]"), *map(_cell, cells), F.lit("[/TR]"))


def markup_table(
    table: DataFrame, headings: Mapping[str, str], order: Sequence[Column]
) -> DataFrame:
    """A report as the lines of one table, in order: opening, rows, closing.

    A table of all authors can be long, so its lines stay distributed rather
    than being joined into one value; written as text, the part files in order
    are the table.
    """
    cells = [
        F.concat(F.col(c).cast("string"), F.lit("%"))
        if c in PERCENT_COLUMNS
        else F.col(c).cast("string")
        for c in headings
    ]
    body = table.withColumn("line", _row(cells)).withColumn("section", F.lit(1))
    first = F.concat(F.lit("[TABLE=full]"), _row([F.lit(h) for h in headings.values()]))
    frame = table.sparkSession.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("section"), first.alias("line")),
                F.struct(F.lit(2).alias("section"), F.lit("[/TABLE]").alias("line")),
            )
        )
    )
    lines = body.unionByName(frame, allowMissingColumns=True)
    return lines.orderBy("section", *order).select("line")
