"""Calendar and clock: wall-clock time for days and years, instants for spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]XX"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def instant_of_iso(text: Column) -> Column:
    """Instant of an ISO-8601 string that carries its offset; NULL if unreadable.

    ``+0200`` and ``+02:00`` and ``Z`` are all read; seconds and their fraction may be missing.
    """
    compact = F.regexp_replace(text, r"([+-]\d\d):(\d\d)$", "$1$2")
    return F.try_to_timestamp(compact, F.lit(ISO_PATTERN))


def local_of_iso(text: Column) -> Column:
    """Wall-clock time of an ISO-8601 string in its own offset."""
    return F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")


def instant_of_utc(local: Column) -> Column:
    """Instant of a wall-clock time that is known to be UTC.

    Independent of the session time zone, unlike a cast.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), local)
    return F.timestamp_micros(micros)


def year_of(creation_local: Column) -> Column:
    return F.year(creation_local)


def epoch_of(creation_ts: Column) -> Column:
    """Whole Unix seconds."""
    return F.unix_seconds(creation_ts)
