"""Thread pages: reading them and extracting posts from them."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palaver.functions.paging import POSTS_PER_PAGE
from palaver.functions.maps import count_map, sum_map_values
from palaver.functions.text import strip_whitespace, with_text_columns
from palaver.functions.times import instant_of_iso, local_of_iso
from palaver.operators.select import (
    check_one_range,
    filter_page_range,
    filter_pages_of_posts,
    filter_post_range,
)
from palaver.schema import POSTS_COLUMNS, POSTS_SCHEMA
from palaver.session import at_most
from palaver.sources import markup

# The parser travels with the job, so workers need not have this package.
cloudpickle.register_pickle_by_value(markup)

# First digits of the file name, and the name of the folder it lies in.
FILE_NAME_DIGITS = r"[^/0-9]*(\d+)[^/]*$"
FOLDER_PATTERN = r"([^/]+)/[^/]+$"

_STRINGS = T.ArrayType(T.StringType())
PAGE_FIELDS = [
    T.StructField("thread_id", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
]
MESSAGE_SCHEMA = T.StructType(
    [
        *PAGE_FIELDS,
        T.StructField("data_author", T.StringType()),
        T.StructField("data_content", T.StringType()),
        T.StructField("fourth_item", T.StringType()),
        T.StructField("user_ids", _STRINGS),
        T.StructField("datetime", T.StringType()),
        T.StructField("liking_names", T.IntegerType()),
        T.StructField("likes_text", T.StringType()),
        T.StructField("quotes", _STRINGS),
        T.StructField("spoilers", T.IntegerType()),
        T.StructField("is_edited", T.BooleanType()),
        T.StructField("emojis", _STRINGS),
        T.StructField("raw_content", T.StringType()),
        # Whether the tokenizer gave up inside this message.
        T.StructField("is_cut", T.BooleanType()),
        # Set in the one record for each page itself.
        T.StructField("page_messages", T.IntegerType()),
        T.StructField("page_problem", T.StringType()),
    ]
)
OUTLINE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("links", T.LongType()),
        T.StructField("paragraphs", T.LongType()),
    ]
)
# Folders are listed by this many tasks a core; Spark's default, a task each, takes longer to schedule than to list.
LISTING_TASKS = 4
# Messages are handed back in batches of this many, whatever a page holds.
BATCH_ROWS = 512


def page_columns(
    files: DataFrame,
    thread_pattern: str = FOLDER_PATTERN,
    page_pattern: str = FILE_NAME_DIGITS,
) -> DataFrame:
    """Whole-file text rows → pages; works on batch and stream readers alike."""
    address = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    path = F.url_decode(address)
    number = F.nullif(F.regexp_extract(path, page_pattern, 1), F.lit(""))
    return files.select(
        F.regexp_extract(path, thread_pattern, 1).alias("thread_id"),
        number.try_cast("int").alias("page_num"),
        path.alias("source_path"),
        F.col("_metadata.file_modification_time").alias("ingested_at"),
        F.make_valid_utf8("value").alias("html"),
    )


def read_pages(
    spark: SparkSession,
    path: str | list[str],
    thread_pattern: str = FOLDER_PATTERN,
    page_pattern: str = FILE_NAME_DIGITS,
    recursive: bool = False,
) -> DataFrame:
    """One row per page file: thread_id, page_num, source_path, ingested_at, html.

    The thread is the folder, the page number the first digits of the file name.
    Sub-folders are skipped unless ``recursive``.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    tasks = LISTING_TASKS * spark.sparkContext.defaultParallelism
    with at_most(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks):
        files = reader.text(path, wholetext=True)
    return page_columns(files, thread_pattern, page_pattern)


PACKED_SCHEMA = "thread_id string, page_num int, html string"


def write_pages(pages: DataFrame, path: str, mode: str = "error") -> None:
    """Pages packed as Parquet: at scale one file per page is slow to list."""
    pages.select("thread_id", "page_num", "html").write.mode(mode).parquet(path)


def packed_page_columns(packed: DataFrame) -> DataFrame:
    """Packed pages → pages; works on batch and stream readers alike."""
    return packed.select(
        "thread_id",
        "page_num",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_modification_time").alias("ingested_at"),
        F.make_valid_utf8("html").alias("html"),
    )


def read_packed_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages from ``write_pages``."""
    paths = [path] if isinstance(path, str) else path
    reader = spark.read.schema(PACKED_SCHEMA).option("recursiveFileLookup", "true")
    return packed_page_columns(reader.parquet(*paths))


def extract_messages(pages: DataFrame) -> DataFrame:
    """Raw message records of all pages, and one for each page; the only step run by Python workers.

    A page is parsed once, where it was read: nothing is shuffled. Only the
    needed columns are sent over.
    """
    names = [f.name for f in PAGE_FIELDS]
    parse = markup.message_batches(names, to_arrow_schema(MESSAGE_SCHEMA), BATCH_ROWS)
    return pages.select(*names, "html").mapInArrow(parse, MESSAGE_SCHEMA)


def _likes(names: Column, text: Column) -> Column:
    """Shown names; from three on there may be a number of further likes. NULL if beyond the type."""
    more = F.regexp_extract(text, r"\d+", 0)
    more = F.when(F.coalesce(more, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(more.try_cast("int"))
    return F.when(names < 3, names).otherwise((names + more).try_cast("int"))


def _known_ids(ids: Column) -> Column:
    return F.transform(ids, lambda i: F.coalesce(i, F.lit("0")))


def posts_of_messages(messages: DataFrame, pages: bool = False) -> DataFrame:
    """Raw messages → posts plus ``problems``, the reasons to reject a post.

    A page that could not be read to its end has a row of its own with the problem;
    with ``pages`` every page has one, told by ``page_messages``.
    """
    m = F.col
    if not pages:
        messages = messages.filter("page_messages is null or page_problem is not null")
    digits = F.replace(
        F.substring("fourth_item", F.lit(2), F.length("fourth_item")), F.lit("."), F.lit("")
    )
    read = messages.select(
        "*",
        F.nullif(F.regexp_extract("data_content", r"post-(\d+)", 1), F.lit("")).alias("post_id"),
        digits.try_cast("bigint").alias("post_num"),
        instant_of_iso(m("datetime")).alias("creation_ts"),
        local_of_iso(m("datetime")).alias("creation_local"),
        strip_whitespace(m("raw_content")).alias("content"),
        _likes(m("liking_names"), m("likes_text")).alias("like_count"),
        F.coalesce(F.try_element_at("user_ids", F.lit(1)), F.lit("0")).alias("author_id"),
        _known_ids(F.slice("user_ids", 2, F.greatest(F.size("user_ids"), F.lit(1)))).alias(
            "mentioned_list"
        ),
    )
    broken = {
        "page_num": m("page_num").isNull(),
        "post_id": m("post_id").isNull(),
        "post_num": m("post_num").isNull(),
        "author": m("data_author").isNull(),
        "datetime": m("creation_ts").isNull() | m("creation_local").isNull(),
        "content": m("raw_content").isNull(),
        "likes": m("like_count").isNull(),
        "quote": F.coalesce(F.exists("quotes", lambda q: q.isNull()), F.lit(False)),
        "emoji": F.coalesce(F.exists("emojis", lambda e: e.isNull()), F.lit(False)),
        "cut": m("is_cut"),
    }
    of_page = F.array_compact(F.array(F.concat(F.lit("page: "), m("page_problem"))))
    problems = F.when(m("page_messages").isNotNull(), of_page).otherwise(
        F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in broken.items()]))
    )
    counted = read.withColumn("problems", problems).withColumn(
        "emoji_frequency_mapping", count_map(F.array_compact("emojis"))
    )
    full = with_text_columns(counted).select(
        "*",
        m("data_author").alias("author"),
        m("datetime").alias("creation_datetime"),
        F.size("quotes").alias("quote_count"),
        m("quotes").alias("quoted_list"),
        m("spoilers").alias("spoiler_count"),
        F.size("mentioned_list").alias("mentions_count"),
        sum_map_values(m("emoji_frequency_mapping")).alias("emoji_count"),
    )
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in POSTS_SCHEMA]
    return full.select(*typed, "problems", *(["page_messages"] if pages else []))


def accepted(extracted: DataFrame, strict: bool = False) -> DataFrame:
    """The posts table; ``strict`` fails the job at the first broken post."""
    good = F.size("problems") == 0
    if strict:
        where = F.concat_ws(", ", F.col("source_path"), F.array_join("problems", " "))
        good = F.when(good, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("unreadable post: "), where))
        )
    return extracted.filter(good).select(*POSTS_COLUMNS)


def quarantined(extracted: DataFrame) -> DataFrame:
    """Posts that could not be read, and pages that could not be read to their end, with the reasons."""
    return extracted.filter(F.size("problems") > 0)


def extract(
    pages: DataFrame,
    page_range: range | None = None,
    post_range: range | None = None,
    posts_per_page: int | None = POSTS_PER_PAGE,
) -> DataFrame:
    """Pages → posts and ``problems``; ranges skip pages before they are parsed."""
    check_one_range(page_range, post_range)
    wanted = filter_pages_of_posts(filter_page_range(pages, page_range), post_range, posts_per_page)
    return filter_post_range(posts_of_messages(extract_messages(wanted)), post_range)


def extract_posts(
    pages: DataFrame,
    page_range: range | None = None,
    post_range: range | None = None,
    strict: bool = False,
) -> DataFrame:
    """The posts table of the given pages."""
    return accepted(extract(pages, page_range, post_range), strict)


def extract_generic(pages: DataFrame) -> DataFrame:
    """Text, link count and paragraph count of any web pages (page_id, html)."""
    parse = markup.outline_batches(to_arrow_schema(OUTLINE_SCHEMA))
    return pages.select("page_id", "html").mapInArrow(parse, OUTLINE_SCHEMA)
