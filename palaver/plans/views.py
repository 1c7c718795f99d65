"""The supplied tables seen as posts, for the query catalog.

The same definitions exist in SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.paging import page_of_post
from palaver.functions.text import strip_whitespace, with_text_columns
from palaver.functions.times import instant_of_utc
from palaver.schema import POSTS_SCHEMA
from palaver.session import shuffle_width, spread

_STRINGS = T.ArrayType(T.StringType())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(start: str, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit(start).cast("timestamp_ntz"))


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: a source is an author, a language a thread."""
    post_num = F.col("doc_id") + 1
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    rows = documents.select(
        F.col("lang").alias("thread_id"),
        post_num.alias("post_num"),
        page_of_post(post_num).cast("int").alias("page_num"),
        F.col("source").alias("author"),
        F.regexp_extract("source", r"\d+", 0).alias("author_id"),
        _local("2020-01-01", F.col("doc_id") * 6 * 3600).alias("creation_local"),
        strip_whitespace(F.col("text")).alias("content"),
    )
    return with_text_columns(rows)


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: clicks mention, views quote."""
    post_num = F.col("event_id") + 1
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        post_num.alias("post_num"),
        page_of_post(post_num).cast("int").alias("page_num"),
        F.concat(F.lit("user"), F.col("user_id")).alias("author"),
        F.col("user_id").cast("string").alias("author_id"),
        F.col("ts").alias("creation_local"),
        F.floor("value").cast("int").alias("word_count"),
        F.when(kind == "click", F.array(k, (F.col("event_id") % 150).cast("string")))
        .otherwise(F.array().cast(_STRINGS))
        .alias("mentioned_list"),
        F.when(kind == "view", F.array(F.concat(F.lit("user"), k)))
        .when(kind == "purchase", F.array(F.lit("")))
        .otherwise(F.array().cast(_STRINGS))
        .alias("quoted_list"),
    )
    return rows.select(
        "*",
        instant_of_utc(F.col("creation_local")).alias("creation_ts"),
        F.size("mentioned_list").alias("mentions_count"),
        F.size("quoted_list").alias("quote_count"),
    )


def emo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as one post whose emojis are the event types."""
    counts = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    )
    # A handful of event types each, so the list per post stays short.
    pairs = F.array_sort(F.collect_list(F.struct("event_type", F.col("n").cast("int"))))
    return counts.groupBy("user_id", "day").agg(
        (F.min("first_id") + 1).alias("post_num"),
        F.concat(F.lit("user"), F.col("user_id")).alias("author"),
        F.map_from_entries(pairs).alias("emoji_frequency_mapping"),
        F.sum("n").cast("int").alias("emoji_count"),
    ).drop("user_id", "day")


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts over several years: a priority is a thread."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderpriority").alias("thread_id"),
            (F.col("o_orderkey") + 1).alias("post_num"),
            F.concat(F.lit("c"), F.col("o_custkey")).alias("author"),
            F.col("o_orderdate").alias("creation_local"),
            F.floor("o_totalprice").cast("int").alias("word_count"),
        )
        .withColumn("creation_ts", instant_of_utc(F.col("creation_local")))
    )


# --- conversations rendered as thread pages ----------------------------------


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _times(times: Column, piece: str) -> Column:
    return F.repeat(F.lit(piece), times.cast("int"))


# In long threads each conversation takes up this many post numbers, so that threads
# have gaps, pages cut conversations and numbers pass one thousand.
LONG_STRIDE = 33
LONG_THREADS = 2


def thread_pages(
    spark: SparkSession, sf_dir: str, max_turn: int | None = None, long: bool = False
) -> DataFrame:
    """Conversations as thread pages (thread_id, page_num, html).

    A turn's number decides how many quotes, mentions, likes, spoilers and
    smilies its post has, so that each can be checked. ``max_turn`` renders the
    threads as they were when that turn was the last. With ``long`` every second
    conversation goes into the same thread, one behind the other.
    """
    turns = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    thread_id, post_num = conv.cast("string"), F.col("turn") + 1
    if long:
        thread_id = F.concat(F.lit("long"), conv % LONG_THREADS)
        post_num += F.floor(conv / LONG_THREADS) * LONG_STRIDE
    if max_turn is not None:
        turns = turns.filter(F.col("turn") <= max_turn)
    turn, role = F.col("turn"), F.col("role")
    user_id = (
        F.when(role == "system", F.lit("1"))
        .when(role == "user", F.lit("2"))
        .otherwise(F.lit("3"))
    )
    local = F.date_format(
        _local("2020-05-11", F.col("conv_id") * 60 + turn), "yyyy-MM-dd'T'HH:mm:ss"
    )
    number = F.replace(F.format_number(post_num, 0), F.lit(","), F.lit("."))
    post = F.concat(
        F.lit('<article class="message message--post" data-author="'),
        _escaped(role),
        F.lit('" data-content="post-'),
        (F.col("conv_id") * 100 + turn).cast("string"),
        F.lit('"><a class="username" data-user-id="'),
        user_id,
        F.lit('">x</a><ul><li>a</li><li>b</li><li>c</li><li> #'),
        number,
        F.lit('</li></ul><time class="u-dt" datetime="'),
        local,
        F.lit('+0200"></time><div class="message-content"><p>Ansehen auf</p>'),
        F.when(
            turn > 0,
            F.lit(
                '<blockquote class="bbCodeBlock--quote" data-quote="user">Quoted '
                '<img class="smilie" data-shortname=":no:">'
                '<a class="username" data-user-id="2">@y</a></blockquote>'
            ),
        ).otherwise(F.lit("")),
        _escaped(F.col("text")),
        _times(turn % 3, '<img class="smilie" data-shortname=":smile:">'),
        _times(turn % 2, '<img class="smilie smilie--x" data-shortname=":joy:">'),
        _times(turn % 2, '<div class="bbCodeSpoiler"><a class="username"></a></div>'),
        _times((turn == 2).cast("int"), '<div class="message-lastEdit">Edited</div>'),
        F.lit("<script>var x = '</p>';</script></div>"),
        F.when(
            turn > 0,
            F.concat(
                F.lit('<a class="reactionsBar-link">'),
                _times(F.least(turn, F.lit(3)), "<bdi>u1</bdi>, "),
                F.when(
                    turn > 3,
                    F.concat(F.lit("and "), turn.cast("string"), F.lit(" others")),
                ).otherwise(F.lit("")),
                F.lit("</a>"),
            ),
        ).otherwise(F.lit("")),
        F.lit("</article>"),
    )
    page = page_of_post(post_num).cast("int")
    # A page holds at most twenty posts.
    posts = F.array_sort(F.collect_list(F.struct(post_num.alias("num"), post.alias("html"))))
    body = F.array_join(F.transform(posts, lambda p: p["html"]), "")
    # Shuffled by page up front: the grouping needs no further shuffle, and as a
    # set number of partitions it is not merged into few, whose pages the parser
    # would then work through alone.
    keyed = turns.withColumns(
        {"thread_id": thread_id, "page_num": page}
    ).repartition(shuffle_width(spark), "thread_id", "page_num")
    html = F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))
    return keyed.groupBy("thread_id", "page_num").agg(html.alias("html"))


def with_page_origin(pages: DataFrame) -> DataFrame:
    """Add the two columns that pages read from files have."""
    return pages.select(
        "*",
        F.concat_ws("/", "thread_id", "page_num").alias("source_path"),
        F.timestamp_seconds(F.lit(0)).alias("ingested_at"),
    )


def write_page_files(pages: DataFrame, path: str) -> None:
    """One file per page, in folders ``thread_id=…/page=page_NNNN.html``."""
    name = F.format_string("page_%04d.html", F.col("page_num"))
    pages.select("thread_id", name.alias("page"), "html").write.partitionBy(
        "thread_id", "page"
    ).text(path)


THREAD_FOLDER = r"thread_id=([^/]+)/"
PAGE_FOLDER = r"page=page_(\d+)"


def whole_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc`` with a value in every column of a posts table."""
    num = F.col("post_num")
    lists = F.array("author", F.lit("x"))
    return as_posts(
        doc(spark, sf_dir).select(
            "*",
            (num - 1).cast("string").alias("post_id"),
            F.date_format("creation_local", "yyyy-MM-dd'T'HH:mm:ss'+0000'").alias("creation_datetime"),
            (num % 7).alias("like_count"),
            F.when(num % 3 > 0, F.slice(lists, 1, (num % 3).cast("int"))).alias("quoted_list"),
            (num % 3).alias("quote_count"),
            (num % 5).alias("spoiler_count"),
            F.when(num % 2 == 0, lists).otherwise(F.array().cast(_STRINGS)).alias("mentioned_list"),
            F.when(num % 2 == 0, 2).otherwise(0).alias("mentions_count"),
            (num % 4).alias("emoji_count"),
            F.create_map(F.lit(":a:"), (num % 4).cast("int")).alias("emoji_frequency_mapping"),
            (num % 11 == 0).alias("is_edited"),
            instant_of_utc(F.col("creation_local")).alias("creation_ts"),
            F.timestamp_seconds(num).alias("ingested_at"),
            F.concat_ws("/", "thread_id", "page_num").alias("source_path"),
        )
    )


def as_posts(df: DataFrame) -> DataFrame:
    """Fill the columns a view does not define, giving a full posts table."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in POSTS_SCHEMA
        ]
    )
