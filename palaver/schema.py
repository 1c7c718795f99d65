"""The posts table: column names, types, and the check applied on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

# The twenty extracted columns, in their fixed order.
POST_FIELDS = [
    T.StructField("post_id", T.StringType()),
    T.StructField("post_num", T.LongType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("creation_datetime", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("like_count", T.IntegerType()),
    T.StructField("quote_count", T.IntegerType()),
    T.StructField("quoted_list", _STRINGS),
    T.StructField("spoiler_count", T.IntegerType()),
    T.StructField("mentions_count", T.IntegerType()),
    T.StructField("mentioned_list", _STRINGS),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("words", _STRINGS),
    T.StructField("emoji_count", T.IntegerType()),
    T.StructField("emoji_frequency_mapping", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("is_edited", T.BooleanType()),
    T.StructField("is_rules_compliant", T.BooleanType()),
    T.StructField("rulebreak_reasons", _STRINGS),
]

# What this engine adds: which thread a post belongs to, its time as an instant
# (durations) and as wall-clock time in the post's own offset (calendar days and
# years), and where and when the page it came from was stored.
POSTS_SCHEMA = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        *POST_FIELDS,
        T.StructField("creation_ts", T.TimestampType()),
        T.StructField("creation_local", T.TimestampNTZType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("source_path", T.StringType()),
    ]
)

POSTS_COLUMNS = POSTS_SCHEMA.names

# As extracted: with the reasons, if any, why a post could not be read.
EXTRACTED_SCHEMA = T.StructType(
    [*POSTS_SCHEMA.fields, T.StructField("problems", _STRINGS)]
)

# One row for each parsed copy of a page: how many messages it held, and what was wrong.
PAGES_SCHEMA = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("page_messages", T.IntegerType()),
        T.StructField("problems", _STRINGS),
    ]
)


def check_posts_columns(df: DataFrame) -> DataFrame:
    """Return ``df`` if it is a posts table, else raise ``ValueError``."""
    if df.columns != POSTS_COLUMNS:
        missing = [c for c in POSTS_COLUMNS if c not in df.columns]
        extra = [c for c in df.columns if c not in POSTS_COLUMNS]
        raise ValueError(
            f"not a posts table: missing {missing}, unexpected {extra}, "
            "or the columns are in another order"
        )
    return df
