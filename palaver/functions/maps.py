"""Map columns: emoji → count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_map(items: Column) -> Column:
    """Array of strings → map of string to its number of occurrences.

    Keys keep the order in which they first appear.
    """
    distinct = F.array_distinct(items)
    counts = F.transform(
        distinct, lambda key: F.size(F.filter(items, lambda item: item == key))
    )
    return F.map_from_arrays(distinct, counts)


def tagged_entries(lists: dict[str, Column], counts: dict[str, Column]) -> Column:
    """Entries of several lists and count maps as one array of (kind, item, n).

    Exploding it gives the rows of all of them in one pass over the posts. NULL
    collections have no entries.
    """
    parts = [F.transform(items, _list_entry(kind)) for kind, items in lists.items()]
    parts += [F.transform(F.map_entries(m), _map_entry(kind)) for kind, m in counts.items()]
    return F.flatten(F.array_compact(F.array(*parts)))


def _entry(kind: str, item: Column, n: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), item.alias("item"), n.cast("bigint").alias("n"))


def _list_entry(kind: str) -> Callable[[Column], Column]:
    return lambda item: _entry(kind, item, F.lit(1))


def _map_entry(kind: str) -> Callable[[Column], Column]:
    return lambda entry: _entry(kind, entry["key"], entry["value"])


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two count maps, adding the counts of shared keys."""
    return F.map_zip_with(
        left, right, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    )


def sum_map_values(counts: Column) -> Column:
    return F.aggregate(
        F.map_values(counts), F.lit(0).cast("bigint"), lambda total, n: total + n
    )
