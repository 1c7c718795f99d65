"""Every operator bound to a supplied table: name → fn(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import maps, paging, text, times
from palaver.operators import authors as A
from palaver.operators import emojis as E
from palaver.operators import forecast as FC
from palaver.operators import letters as L
from palaver.operators import references as R
from palaver.operators import select as S
from palaver.operators import years as Y
from palaver.operators.frontier import frontier_pages as list_frontier
from palaver.operators.occurrences import FIRST_SEEN, seen_at
from palaver.operators.ranking import totals_of
from palaver.operators.ranking import share_of_total as add_share
from palaver.operators.ranking import top_n as first_n
from palaver.operators.ranking import top_n_with_rest as first_n_and_rest
from palaver.plans import markup, reports, views
from palaver.sources import pages as P
from palaver.sources import posts as posts_io
from palaver.session import scratch_path, spread
from palaver.streaming.ingest import compact, ingest_pages, ingested_posts, live_posts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL counterparts.
PAGES = range(3, 400, 7)
POSTS = range(50, 5_000, 3)
LONG_PAGES = range(3, 1_000_000, 2)
LONG_POSTS = range(30, 10_000_000, 7)
TIMES = (1_704_240_000, 1_705_500_000)
YEARS = (757_382_400, 836_136_000)  # 1994-01-01 to 1996-06-30 12:00, UTC
YEAR = 1997
GOAL_FACTOR = 3
SYMBOLS = (("click", "\U0001f5b1"), ("view", "\U0001f440"), ("purchase", "\U0001f6d2"))
BASE_URL = "https://forum.example/threads/t.1/"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def big(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines report one type."""
    small = [c for c, t in df.dtypes if t in ("int", "smallint", "tinyint")]
    return df.withColumns({c: F.col(c).cast("bigint") for c in small})


def seen(df: DataFrame) -> DataFrame:
    """The first appearance as post number and position."""
    return df.select(*[c for c in df.columns if c != FIRST_SEEN], *seen_at())


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- sources and sinks --------------------------------------------------------


@query
def src_html_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    views.write_page_files(views.thread_pages(spark, sf_dir), path)
    pages = P.read_pages(
        spark, path, views.THREAD_FOLDER, views.PAGE_FOLDER, recursive=True
    )
    articles = F.size(F.split("html", "<article ")) - 1
    return big(pages.select("thread_id", "page_num", articles.alias("posts")))


def _posts_round_trip(spark, sf_dir, fmt):
    path = scratch_path(spark, f"posts-{fmt}")
    posts_io.write_posts(views.whole_posts(spark, sf_dir), path, fmt)
    return posts_io.read_posts(spark, path, fmt)


def _post_facts(df):
    """All columns of a posts table; lists, maps and times as plain values."""
    plain = {}
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            plain[name] = F.array_join(name, "|")
        elif kind.startswith("map"):
            pairs = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"]))
            plain[name] = F.array_join(pairs, "|")
        elif kind == "timestamp":
            plain[name] = F.unix_seconds(name)
        elif kind == "timestamp_ntz":
            plain[name] = _stamp(name)
    return big(df.withColumns(plain))


@query
def src_posts(spark, sf_dir):
    return _post_facts(_posts_round_trip(spark, sf_dir, "json"))


@query
def sink_posts(spark, sf_dir):
    return _post_facts(_posts_round_trip(spark, sf_dir, "parquet"))


@query
def sink_report(spark, sf_dir):
    path = scratch_path(spark, "report") + ".csv"
    posts_io.write_report(reports.author_table(views.doc(spark, sf_dir)), path)
    schema = "author string, messages bigint, violations bigint, violation_pct double"
    schema += ", violation_rate double, first_post bigint"
    return spark.read.csv(path, header=True, schema=schema)


@query
def concat_parts(spark, sf_dir):
    posts = views.doc(spark, sf_dir).select("post_num", "author", "thread_id")
    early = F.coalesce(F.col("thread_id") < "en", F.lit(False))
    return posts_io.concat_parts(posts.filter(early), posts.filter(~early))


@query
def sort_posts(spark, sf_dir):
    return posts_io.sort_posts(views.doc(spark, sf_dir).select("post_num", "author"))


# --- extraction ---------------------------------------------------------------


def _extracted(spark, sf_dir):
    pages = views.with_page_origin(views.thread_pages(spark, sf_dir))
    return P.extract_posts(pages)


def _extracted_facts(posts):
    return big(
        posts.select(
            "thread_id",
            "post_num",
            "page_num",
            "post_id",
            "author",
            "author_id",
            "creation_datetime",
            _stamp("creation_local"),
            F.unix_seconds("creation_ts").alias("epoch"),
            "content",
            "like_count",
            "quote_count",
            "spoiler_count",
            "mentions_count",
            "word_count",
            "emoji_count",
            "is_edited",
            "is_rules_compliant",
        )
    )


@query
def extract_posts(spark, sf_dir):
    return _extracted_facts(_extracted(spark, sf_dir))


def _long_threads(spark, sf_dir):
    return views.with_page_origin(views.thread_pages(spark, sf_dir, long=True))


@query
def extract_long_threads(spark, sf_dir):
    """Threads of many pages, with post numbers beyond a thousand."""
    return _extracted_facts(P.extract_posts(_long_threads(spark, sf_dir)))


@query
def extract_page_range(spark, sf_dir):
    """Every second page from the third on; the others are not parsed."""
    return _extracted_facts(P.extract_posts(_long_threads(spark, sf_dir), page_range=LONG_PAGES))


@query
def extract_post_range(spark, sf_dir):
    """Posts of a range with a step, on the pages that can hold them."""
    return _extracted_facts(P.extract_posts(_long_threads(spark, sf_dir), post_range=LONG_POSTS))


@query
def extract_lists(spark, sf_dir):
    """The list and map columns, one row per entry, from one parse of the pages."""
    entries = maps.tagged_entries(
        {"quote": F.col("quoted_list"), "mention": F.col("mentioned_list")},
        {"emoji": F.col("emoji_frequency_mapping")},
    )
    rows = _extracted(spark, sf_dir).select("thread_id", "post_num", F.explode(entries).alias("e"))
    return rows.select("thread_id", "post_num", "e.*")


@query
def extract_generic(spark, sf_dir):
    pages = spread(views.table(spark, sf_dir, "pages"), "page_id")
    outlines = P.extract_generic(pages)
    return outlines.select("page_id", "links", "paragraphs")


# --- text and row-level functions ----------------------------------------------


@query
def split_words(spark, sf_dir):
    words = views.doc(spark, sf_dir).select("post_num", "words")
    return words.select("post_num", F.array_join("words", "|").alias("words"))


@query
def word_count(spark, sf_dir):
    return big(views.doc(spark, sf_dir).select("post_num", "word_count"))


def _stripped(spark, sf_dir):
    content = text.strip_content(F.col("content")).alias("stripped")
    return views.doc(spark, sf_dir).select("post_num", "word_count", content)


@query
def strip_content(spark, sf_dir):
    return _stripped(spark, sf_dir).select("post_num", "stripped")


@query
def rule_word_count(spark, sf_dir):
    kept = text.rule_word_count(F.col("stripped"), F.col("word_count"))
    return _stripped(spark, sf_dir).select("post_num", kept.alias("kept"))


@query
def rule_first_letter(spark, sf_dir):
    kept = text.rule_first_letter(F.col("stripped"))
    return _stripped(spark, sf_dir).select("post_num", kept.alias("kept"))


@query
def rule_punctuation(spark, sf_dir):
    kept = text.rule_punctuation(F.col("stripped"))
    return _stripped(spark, sf_dir).select("post_num", kept.alias("kept"))


@query
def rulebreak_reasons(spark, sf_dir):
    reasons = F.array_join("rulebreak_reasons", ",").alias("reasons")
    return views.doc(spark, sf_dir).select("post_num", reasons)


@query
def is_rules_compliant(spark, sf_dir):
    return views.doc(spark, sf_dir).select("post_num", "is_rules_compliant")


@query
def page_of_post(spark, sf_dir):
    page = paging.page_of_post(F.col("post_num")).alias("page")
    return views.evt(spark, sf_dir).select("post_num", page)


@query
def page_post_bounds(spark, sf_dir):
    pages = views.evt(spark, sf_dir).select("page_num").distinct()
    page = F.col("page_num")
    return big(
        pages.select(
            page,
            paging.first_post_of_page(page).alias("first_post"),
            paging.last_post_of_page(page).alias("last_post"),
        )
    )


@query
def page_from_url(spark, sf_dir):
    page = paging.page_from_url(F.col("url")).alias("page")
    return views.table(spark, sf_dir, "pages").select("page_id", page)


@query
def url_for_page(spark, sf_dir):
    url = paging.url_for_page(F.lit(BASE_URL), F.col("page_id") + 1)
    back = paging.page_from_url(F.rtrim(url, F.lit("/")))
    return views.table(spark, sf_dir, "pages").select(
        "page_id", url.alias("url"), back.alias("page")
    )


@query
def year_of(spark, sf_dir):
    year = times.year_of(F.col("creation_local")).alias("year")
    return big(views.ord_(spark, sf_dir).select("post_num", year))


@query
def epoch_of(spark, sf_dir):
    epoch = times.epoch_of(F.col("creation_ts")).alias("epoch")
    return views.evt(spark, sf_dir).select("post_num", epoch)


@query
def shortcode_to_emoji(spark, sf_dir):
    names = spark.createDataFrame(SYMBOLS, "shortcode string, symbol string")
    stats = E.emoji_frequency(views.emo(spark, sf_dir)).select("emoji", "count")
    return E.shortcode_to_emoji(stats, names)


# --- selections -----------------------------------------------------------------


@query
def filter_page_range(spark, sf_dir):
    posts = views.evt(spark, sf_dir).select("post_num", "page_num")
    return big(S.filter_page_range(posts, PAGES))


@query
def filter_post_range(spark, sf_dir):
    posts = views.evt(spark, sf_dir).select("post_num", "page_num")
    return big(S.filter_post_range(posts, POSTS))


@query
def filter_page_span(spark, sf_dir):
    posts = views.evt(spark, sf_dir).select("post_num", "page_num")
    return big(S.select_span(posts, pages=PAGES))


@query
def filter_post_span(spark, sf_dir):
    posts = views.evt(spark, sf_dir).select("post_num", "page_num")
    return big(S.select_span(posts, posts=POSTS))


@query
def filter_author(spark, sf_dir):
    return S.filter_author(views.doc(spark, sf_dir), "src7").select("post_num", "author")


@query
def filter_time_range(spark, sf_dir):
    return S.filter_time_range(views.evt(spark, sf_dir), *TIMES).select("post_num")


@query
def filter_year(spark, sf_dir):
    return S.filter_year(views.ord_(spark, sf_dir), YEAR).select("post_num", "author")


@query
def filter_violations(spark, sf_dir):
    return S.filter_violations(views.doc(spark, sf_dir)).select("post_num", "author")


@query
def having_min_messages(spark, sf_dir):
    stats = A.messages_by_author(views.doc(spark, sf_dir))
    return S.having_min_messages(stats, 50)


@query
def filter_unknown(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    both = F.concat("mentioned_list", "quoted_list")
    return S.filter_unknown(posts.select("post_num", F.explode(both).alias("who")), "who")


@query
def filter_chars(spark, sf_dir):
    counts = L.char_counts_all(views.doc(spark, sf_dir))
    return L.filter_chars(counts, "aeiouäöü").select("char", "count")


# --- joins ------------------------------------------------------------------------


@query
def lookup_author_name(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    ids = posts.select(F.explode("mentioned_list").alias("user_id")).distinct()
    return R.lookup_author_name(ids, posts)


@query
def frontier_pages(spark, sf_dir):
    known = views.doc(spark, sf_dir).select(
        F.col("author").alias("thread_id"), "page_num"
    ).distinct()
    last = known.groupBy("thread_id").agg((F.max("page_num") + 5).alias("last_page"))
    return big(list_frontier(known, last, fill_gaps=True))


@query
def frontier_pages_newest(spark, sf_dir):
    known = views.doc(spark, sf_dir).select(
        F.col("author").alias("thread_id"), "page_num"
    ).distinct()
    last = known.groupBy("thread_id").agg((F.max("page_num") + 5).alias("last_page"))
    return big(list_frontier(known, last))


# --- aggregates ---------------------------------------------------------------------


@query
def total_messages(spark, sf_dir):
    return A.total_messages(views.doc(spark, sf_dir))


@query
def total_words(spark, sf_dir):
    return A.total_words(views.doc(spark, sf_dir))


@query
def words_per_message(spark, sf_dir):
    return A.words_per_message(views.doc(spark, sf_dir))


@query
def words_per_message_by_thread(spark, sf_dir):
    return A.words_per_message(views.doc(spark, sf_dir), ["thread_id"])


@query
def distinct_authors(spark, sf_dir):
    return A.distinct_authors(views.evt(spark, sf_dir))


@query
def distinct_authors_by_thread(spark, sf_dir):
    return A.distinct_authors(views.ord_(spark, sf_dir), ["thread_id"])


@query
def list_authors(spark, sf_dir):
    return A.list_authors(views.evt(spark, sf_dir))


@query
def span_bounds(spark, sf_dir):
    return big(A.span_bounds(views.evt(spark, sf_dir)))


@query
def messages_by_author(spark, sf_dir):
    return A.messages_by_author(views.doc(spark, sf_dir))


@query
def words_by_author(spark, sf_dir):
    return A.words_by_author(views.doc(spark, sf_dir))


@query
def words_per_message_by_author(spark, sf_dir):
    return A.words_per_message_by_author(views.doc(spark, sf_dir))


@query
def violations_by_author(spark, sf_dir):
    return A.violations_by_author(views.doc(spark, sf_dir))


@query
def violation_rate_by_author(spark, sf_dir):
    return A.violation_rate_by_author(views.doc(spark, sf_dir))


@query
def messages_with_mention_by_author(spark, sf_dir):
    return R.messages_with_mention_by_author(views.evt(spark, sf_dir))


@query
def messages_with_quote_by_author(spark, sf_dir):
    return R.messages_with_quote_by_author(views.evt(spark, sf_dir))


@query
def emojis_by_author(spark, sf_dir):
    return E.emojis_by_author(views.emo(spark, sf_dir))


@query
def total_emojis(spark, sf_dir):
    return E.total_emojis(views.emo(spark, sf_dir))


@query
def authors_per_year(spark, sf_dir):
    return big(Y.authors_per_year(views.ord_(spark, sf_dir)))


@query
def messages_per_author_per_year(spark, sf_dir):
    return big(Y.messages_per_author_per_year(views.ord_(spark, sf_dir), ["thread_id"]))


@query
def overall_plus_groups(spark, sf_dir):
    return A.overall_plus_groups(views.doc(spark, sf_dir))


@query
def mean(spark, sf_dir):
    return A.mean(views.doc(spark, sf_dir), "word_count")


# --- arrays and maps ------------------------------------------------------------------


@query
def used_emojis(spark, sf_dir):
    return seen(E.used_emojis(views.emo(spark, sf_dir)))


@query
def emoji_frequency(spark, sf_dir):
    return seen(E.emoji_frequency(views.emo(spark, sf_dir)))


@query
def emoji_map_by_author(spark, sf_dir):
    return seen(E.emoji_counts_by_author(views.emo(spark, sf_dir)))


@query
def merge_maps(spark, sf_dir):
    """Each post's map merged with the fixed map {error: 1, other: 2}."""
    other = F.create_map(F.lit("error"), F.lit(1), F.lit("other"), F.lit(2))
    merged = maps.merge_maps(F.col(E.MAP), other)
    posts = views.emo(spark, sf_dir)
    return big(posts.select("post_num", "author", F.explode(merged).alias("emoji", "n")))


@query
def sum_map_values(spark, sf_dir):
    total = maps.sum_map_values(F.col(E.MAP)).alias("total")
    return views.emo(spark, sf_dir).select("post_num", "author", total)


@query
def times_mentioned(spark, sf_dir):
    return seen(R.times_mentioned(views.evt(spark, sf_dir)))


@query
def times_quoted(spark, sf_dir):
    return seen(R.times_quoted(views.evt(spark, sf_dir)))


@query
def char_counts_all(spark, sf_dir):
    return L.char_counts_all(views.doc(spark, sf_dir))


@query
def char_counts_first(spark, sf_dir):
    return L.char_counts_first(views.doc(spark, sf_dir))


@query
def char_counts_last(spark, sf_dir):
    return L.char_counts_last(views.doc(spark, sf_dir))


# --- ranking -----------------------------------------------------------------------------


@query
def yearly_top_n(spark, sf_dir):
    return big(Y.yearly_top_n(views.ord_(spark, sf_dir), 10, "words"))


@query
def yearly_top_n_large(spark, sf_dir):
    """More rows per group than Spark limits early: groups are ranked in slices."""
    return big(Y.yearly_top_n(views.ord_(spark, sf_dir), 1200, "messages"))


@query
def share_of_total(spark, sf_dir):
    posts = views.ord_(spark, sf_dir)
    stats = Y.author_years(posts)
    totals = Y.year_totals(stats, "messages").select("year", "total")
    shares = add_share(stats, totals, "messages", ["year"], 100.0)
    return big(shares.select("year", "author", "messages", "share"))


@query
def top_n(spark, sf_dir):
    stats = A.messages_by_author(views.doc(spark, sf_dir))
    return first_n(stats, "messages", 5, ("first_post", "author"))


@query
def top_n_with_rest(spark, sf_dir):
    posts = views.doc(spark, sf_dir)
    stats = A.words_by_author(posts)
    totals = totals_of(stats, "words", ("first_post",))
    return first_n_and_rest(stats, totals, "words", "author", 5, ("first_post", "author"))


# --- reports ---------------------------------------------------------------------------------


@query
def rep_author_table(spark, sf_dir):
    return reports.author_table(views.doc(spark, sf_dir))


@query
def rep_author_table_by_thread(spark, sf_dir):
    return reports.author_table(views.doc(spark, sf_dir), by=["thread_id"])


@query
def rep_violation_table(spark, sf_dir):
    return reports.violation_table(views.doc(spark, sf_dir), n=50)


@query
def rep_emoji_table(spark, sf_dir):
    return seen(reports.emoji_table(views.emo(spark, sf_dir)))


@query
def rep_top_share(spark, sf_dir):
    return reports.top_share(views.doc(spark, sf_dir), n=10)


@query
def rep_top_share_words_by_thread(spark, sf_dir):
    posts = views.doc(spark, sf_dir)
    return big(reports.top_share(posts, n=3, criterion="words", by=["thread_id"]))


@query
def rep_yearly_top_share(spark, sf_dir):
    return big(reports.yearly_top_share(views.ord_(spark, sf_dir), n=10))


@query
def rep_yearly_top_share_words_by_thread(spark, sf_dir):
    posts = views.ord_(spark, sf_dir)
    return big(reports.yearly_top_share(posts, 5, "words", by=["thread_id"]))


@query
def rep_emoji_share(spark, sf_dir):
    return seen(reports.emoji_share(views.emo(spark, sf_dir), n=3))


@query
def rep_emoji_share_first_seen(spark, sf_dir):
    return seen(reports.emoji_share(views.emo(spark, sf_dir), n=3, rank_by="first_seen"))


@query
def rep_emoji_distribution(spark, sf_dir):
    return seen(reports.emoji_distribution(views.emo(spark, sf_dir), n=10, n_emojis=3))


@query
def rep_emoji_distribution_all(spark, sf_dir):
    return seen(reports.emoji_distribution(views.emo(spark, sf_dir), n=10, n_emojis=0))


@query
def rep_top_mentioned(spark, sf_dir):
    return seen(reports.top_mentioned(views.evt(spark, sf_dir), n=10))


@query
def rep_top_mentioners(spark, sf_dir):
    return reports.top_mentioners(views.evt(spark, sf_dir), n=10)


@query
def rep_top_quoted(spark, sf_dir):
    return seen(reports.top_quoted(views.evt(spark, sf_dir), n=10))


@query
def rep_top_quoters(spark, sf_dir):
    return reports.top_quoters(views.evt(spark, sf_dir), n=10)


@query
def rep_authors_per_year(spark, sf_dir):
    return big(reports.authors_per_year(views.ord_(spark, sf_dir)))


@query
def rep_messages_per_author_per_year(spark, sf_dir):
    return big(reports.messages_per_author_per_year(views.ord_(spark, sf_dir)))


@query
def rep_words_per_message(spark, sf_dir):
    return reports.words_per_message(views.doc(spark, sf_dir), n=10)


@query
def rep_letters(spark, sf_dir):
    return reports.letters(views.doc(spark, sf_dir))


@query
def rep_letters_first_any(spark, sf_dir):
    posts = views.doc(spark, sf_dir)
    return reports.letters(posts, "count_first", chars=None, case_insensitive=False)


@query
def fmt_markup_table(spark, sf_dir):
    table = reports.author_table(views.doc(spark, sf_dir))
    return markup.markup_table(table, markup.AUTHOR_HEADINGS, markup.by_messages())


@query
def fmt_markup_violations(spark, sf_dir):
    return markup.printable("violation_table", views.doc(spark, sf_dir), n=50)


@query
def fmt_markup_table_emojis(spark, sf_dir):
    return markup.printable("emoji_table", views.emo(spark, sf_dir))


# --- forecast ------------------------------------------------------------------------------------


def _outlook_columns(df):
    return df.withColumns(
        {
            "end_local": F.date_format("end_local", "yyyy-MM-dd HH:mm:ss"),
            "eta": F.date_format("eta", "yyyy-MM-dd HH:mm:ss"),
        }
    )


def _day_as_text(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _goal(spark, sf_dir):
    """Three times the posts there are, so the goal lies ahead at every scale."""
    return GOAL_FACTOR * views.evt(spark, sf_dir).count()


@query
def period_select(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    selected = FC.period_select(posts, 10, 40, "page")
    return selected.select("post_num")


@query
def posting_rate(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    rate = FC.posting_rate(FC.period_select(posts, 100, 4_000, "post"))
    return rate.withColumn("end_local", F.date_format("end_local", "yyyy-MM-dd HH:mm:ss"))


@query
def days_to_goal(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    rate = FC.posting_rate(FC.period_select(posts, *TIMES, "timestamp"))
    goal = _goal(spark, sf_dir)
    total = A.total_messages(posts).scalar()
    return _outlook_columns(FC.days_to_goal(rate, total, goal))


@query
def daily_histogram(spark, sf_dir):
    return _day_as_text(FC.daily_histogram(views.evt(spark, sf_dir)))


@query
def forecast_series(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    period = FC.period_select(posts, 10, 40, "page")
    total = A.total_messages(posts).scalar()
    return _day_as_text(FC.forecast_series(period, total, _goal(spark, sf_dir)))


@query
def rep_forecast(spark, sf_dir):
    posts = views.evt(spark, sf_dir)
    return _day_as_text(
        reports.forecast(posts, _goal(spark, sf_dir), *TIMES, "timestamp")
    )


@query
def rep_forecast_by_thread(spark, sf_dir):
    goal = GOAL_FACTOR * F.col("total")
    return _day_as_text(reports.forecast(views.ord_(spark, sf_dir), goal, *YEARS, "timestamp", by=["thread_id"]))


@query
def rep_forecast_problems(spark, sf_dir):
    """Every second thread has reached its goal, the others lack posts of that number."""
    goal = F.when(F.col("thread_id") < "3", F.col("total")).otherwise(GOAL_FACTOR * F.col("total"))
    return reports.forecast_problems(views.ord_(spark, sf_dir), goal, 2, 1 << 40, "post", by=["thread_id"])


@query
def rep_forecast_summary(spark, sf_dir):
    summary = reports.forecast_summary(
        views.evt(spark, sf_dir), _goal(spark, sf_dir), 10, 40, "page", "(Test)"
    )
    return _outlook_columns(summary.drop("title"))


# --- incremental ingest ------------------------------------------------------------------------------


@query
def ingest_incremental(spark, sf_dir):
    """Threads land as they were after turn 3, later again as they are now; two
    runs of the stream store both, and the newest copy of a page wins."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "ingested")
    for batch, max_turn in enumerate((3, None)):
        pages = views.thread_pages(spark, sf_dir, max_turn)
        P.write_pages(pages, f"{landing}/batch{batch}")
        ingest_pages(spark, landing, out, packed=True)
    return live_posts(spark, out).select("thread_id", "post_num", "author", "content")


@query
def ingest_compacted(spark, sf_dir):
    """The same table after every third thread was emptied, and without the superseded copies:
    what is stored then is what is alive."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "ingested")
    emptied = F.col("thread_id").cast("long") % 3 == 0
    for batch, html in enumerate((F.col("html"), F.when(~emptied, F.col("html")).otherwise(""))):
        P.write_pages(views.thread_pages(spark, sf_dir).withColumn("html", html), f"{landing}/batch{batch}")
        ingest_pages(spark, landing, out, packed=True)
    compact(spark, out)
    return ingested_posts(spark, out).select("thread_id", "post_num", "author", "content")


@query
def quarantined(spark, sf_dir):
    """Threads whose page is missing, or whose markup breaks off behind the last post."""
    kind = F.col("thread_id").cast("long") % 7
    html = F.when(kind == 3, None).when(kind == 5, F.concat("html", F.lit("<![odd["))).otherwise(F.col("html"))
    pages = views.thread_pages(spark, sf_dir).withColumn("html", html)
    path = scratch_path(spark, "pages")
    P.write_pages(pages, path)
    rows = P.quarantined(P.extract(P.read_packed_pages(spark, path)))
    return rows.select("thread_id", "page_num", "post_num", F.array_join("problems", ", ").alias("problems"))


@query
def latest_version(spark, sf_dir):
    """Of each user's events of a type, those with the highest whole value."""
    events = views.table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.floor("value").alias("version")
    )
    return posts_io.latest_version(events, ("user_id", "event_type"), ("version",))
