"""The reports by name, each ``fn(posts, **options) -> DataFrame``.

``by`` names grouping columns such as ``thread_id``; without it a report covers
the whole table. Every report comes sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators import authors as A
from palaver.operators import emojis as E
from palaver.operators import forecast as FC
from palaver.operators import letters as L
from palaver.operators import references as R
from palaver.operators import years as Y
from palaver.operators.occurrences import FIRST_SEEN
from palaver.operators.ranking import (
    order_of,
    share_of_total,
    top_n,
    top_n_with_rest,
    totals_of,
)
from palaver.operators.select import having_min_messages

OTHERS = "Andere"  # fixed value
AUTHOR_TIES = ("first_post", "author")
EMOJI_TIES = (FIRST_SEEN, "emoji")
# Up to this many rows a top-n result is sent to all tasks instead of shuffled.
BROADCAST_ROWS = 10_000


def _violation_columns(df: DataFrame, by: Sequence[str]) -> DataFrame:
    percent = (F.col("violation_rate") * 100).alias("violation_pct")
    return A.violation_rates(df, by).select(
        *by, "author", "messages", "violations", percent, "violation_rate", "first_post"
    )


def author_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages and rule violations of every author, most messages first."""
    return _violation_columns(df, by).orderBy(*by, *order_of("messages", AUTHOR_TIES))


def violation_table(df: DataFrame, n: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """The same for authors of at least ``n`` messages, lowest rate first."""
    stats = having_min_messages(_violation_columns(df, by), n)
    return stats.orderBy(*by, "violation_rate", *AUTHOR_TIES)


def emoji_table(
    df: DataFrame, names: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Uses of every emoji; ``names`` turns shortcodes into symbols."""
    stats = E.emoji_frequency(df, by)
    if names is not None:
        stats = E.shortcode_to_emoji(stats, names)
    return stats.orderBy(*by, *order_of("count", EMOJI_TIES))


def _rest_first(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    return shares.orderBy(
        *by, F.col("is_rest").desc(), *order_of("amount", AUTHOR_TIES)
    )


def top_share(
    df: DataFrame, n: int = 10, criterion: str = "messages", by: Sequence[str] = ()
) -> DataFrame:
    """Share of the n first authors in all messages or words, and the rest."""
    metric = Y.metric_of(criterion)
    stats = A.author_stats(df, by).select(*by, "author", metric, "first_post")
    totals = totals_of(stats, metric, AUTHOR_TIES, by)
    shares = top_n_with_rest(stats, totals, metric, "author", n, AUTHOR_TIES, by)
    return _rest_first(shares, by)


def yearly_top_share(
    df: DataFrame, n: int = 10, criterion: str = "messages", by: Sequence[str] = ()
) -> DataFrame:
    """The same for every calendar year, with ranks; a year without posts is all rest."""
    metric = Y.metric_of(criterion)
    keys = [*by, "year"]
    stats = Y.author_years(df, by).select(*keys, "author", metric, "first_post")
    totals = Y.year_totals(stats, metric, by)
    shares = top_n_with_rest(stats, totals, metric, "author", n, AUTHOR_TIES, keys)
    percent = (F.col("share") * 100).alias("pct")
    return _rest_first(shares, keys).select(
        *keys, "rank", "author", "amount", percent, "is_rest", "first_post"
    )


def emoji_share(
    df: DataFrame, n: int = 10, rank_by: str = "frequency", by: Sequence[str] = ()
) -> DataFrame:
    """Share of n emojis in all emojis: the most used or the first seen."""
    if rank_by not in ("frequency", "first_seen"):
        raise ValueError("rank_by must be frequency or first_seen")
    stats = E.emoji_frequency(df, by)
    if rank_by == "first_seen":
        stats = stats.withColumn("_earliness", -F.col(FIRST_SEEN))
        top = top_n(stats, "_earliness", n, EMOJI_TIES, by).drop("_earliness")
        order = [*by, FIRST_SEEN, "emoji"]
    else:
        top = top_n(stats, "count", n, EMOJI_TIES, by)
        order = [*by, *order_of("count", EMOJI_TIES)]
    shares = share_of_total(top, E.total_emojis(df, by), "count", by)
    return shares.select(*by, "emoji", "count", "share", FIRST_SEEN).orderBy(*order)


def emoji_distribution(
    df: DataFrame, n: int = 10, n_emojis: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Which emojis the n heaviest emoji users used, and how often.

    Emojis are ranked among these users; those past ``n_emojis`` (0: none) are
    summed up per user. A pair without uses has no row.
    """
    counts = E.emoji_counts_by_author(df, by)
    stats = E.emojis_by_author(df, by).withColumnRenamed("emojis", "total")
    users = top_n(stats, "total", n, AUTHOR_TIES, by)
    users = users.select(*by, "author", "total", "first_post")
    used = counts.join(_small(users, n, by), [*by, "author"])
    ranked = used.groupBy(*by, "emoji").agg(
        F.sum("n").alias("uses"), F.min(FIRST_SEEN).alias(FIRST_SEEN)
    )
    if n_emojis:
        shown = top_n(ranked, "uses", n_emojis, EMOJI_TIES, by)
    else:
        shown = ranked
    shown = shown.select(*by, "emoji", F.lit(True).alias("is_shown"))
    if n_emojis:
        shown = _small(shown, n_emojis, by)
    label = F.when(F.col("is_shown"), F.col("emoji")).otherwise(F.lit(OTHERS))
    cells = (
        used.join(shown, [*by, "emoji"], "left")
        .withColumn("is_others", F.col("is_shown").isNull())
        .groupBy(*by, "author", "total", "first_post", label.alias("emoji"), "is_others")
        .agg(F.sum("n").alias("n"), F.min(FIRST_SEEN).alias(FIRST_SEEN))
    )
    inside = ["is_others", *order_of("n", EMOJI_TIES)]
    return cells.orderBy(*by, *order_of("total", AUTHOR_TIES), *inside)


def _small(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Mark n rows for broadcast; with groups the number of rows is not known."""
    return F.broadcast(df) if not by and n <= BROADCAST_ROWS else df


def top_mentioned(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The most mentioned users, by name where they have posted."""
    order = ("times", (FIRST_SEEN, "user_id"))
    top = top_n(R.times_mentioned(df, by), order[0], n, order[1], by)
    few = not by and n <= BROADCAST_ROWS
    named = R.lookup_author_name(top, df, by, few=few)
    return named.select(*by, "user_id", "name", "times", FIRST_SEEN).orderBy(
        *by, *order_of(*order)
    )


def top_quoted(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The most quoted users."""
    order = ("times", (FIRST_SEEN, "user_name"))
    top = top_n(R.times_quoted(df, by), order[0], n, order[1], by)
    return top.select(*by, "user_name", "times", FIRST_SEEN).orderBy(
        *by, *order_of(*order)
    )


def _top_authors(stats: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    top = top_n(stats, "messages", n, AUTHOR_TIES, by)
    return top.select(*by, "author", "messages", "first_post").orderBy(
        *by, *order_of("messages", AUTHOR_TIES)
    )


def top_mentioners(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Authors with the most posts that mention somebody."""
    return _top_authors(R.messages_with_mention_by_author(df, by), n, by)


def top_quoters(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Authors with the most posts that quote somebody."""
    return _top_authors(R.messages_with_quote_by_author(df, by), n, by)


def _checked_period(
    df: DataFrame, goal: int, start: int, end: int, kind: str
) -> tuple[DataFrame, int]:
    facts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.unix_seconds(F.min("creation_ts")).alias("first"),
        F.unix_seconds(F.max("creation_ts")).alias("last"),
    ).first()
    start, end = FC.check_period(
        facts.total, facts.first, facts.last, goal, start, end, kind
    )
    return FC.period_select(df, start, end, kind), facts.total


def forecast(
    df: DataFrame, goal: int | Column, start: int, end: int, kind: str, by: Sequence[str] = ()
) -> DataFrame:
    """Posts a day in a period, continued at its mean rate until the goal.

    Arguments that do not fit the posts raise an error. With ``by`` they leave
    a group out instead, and ``forecast_problems`` tells why; ``goal`` may then be an expression over ``total``.
    """
    if by:
        return FC.forecast_by(df, by, goal, start, end, kind).orderBy(*by, "day", "is_forecast")
    period, total = _checked_period(df, goal, start, end, kind)
    return FC.forecast_series(period, F.lit(total), goal).orderBy("day", "is_forecast")


def forecast_problems(
    df: DataFrame, goal: int | Column, start: int, end: int, kind: str, by: Sequence[str]
) -> DataFrame:
    """Groups that ``forecast`` leaves out, and why."""
    facts = FC.group_facts(FC.daily_facts(df, by, start, end, kind), by, goal, start, end, kind)
    return facts.where("problem is not null").select(*by, "problem").orderBy(*by)


def forecast_summary(
    df: DataFrame, goal: int, start: int, end: int, kind: str, description: str = ""
) -> DataFrame:
    """Title, rate, days to go and expected date of a forecast."""
    period, total = _checked_period(df, goal, start, end, kind)
    outlook = FC.days_to_goal(FC.posting_rate(period), F.lit(total), goal)
    title = f"Prognose: {goal} {description.strip()}".strip()
    return outlook.select(F.lit(title).alias("title"), *outlook.columns)


def authors_per_year(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Different authors in every calendar year."""
    return Y.authors_per_year(df, by).select(*by, "year", "authors").orderBy(*by, "year")


def messages_per_author_per_year(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posts per author in every calendar year."""
    ratios = Y.messages_per_author_per_year(df, by)
    return ratios.select(*by, "year", "messages_per_author").orderBy(*by, "year")


def words_per_message(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Words per message overall and of the n wordiest authors."""
    stats = A.overall_plus_groups(df, by)
    overall = stats.filter("is_overall")
    metric = "words_per_message"
    top = top_n(stats.filter("not is_overall"), metric, n, AUTHOR_TIES, by)
    columns = [*by, "author", metric, "is_overall", "first_post"]
    return (
        overall.select(*columns)
        .unionByName(top.select(*columns))
        .orderBy(*by, F.col("is_overall").desc(), *order_of(metric, AUTHOR_TIES))
    )


def letters(
    df: DataFrame,
    mode: str = "count_all",
    chars: str | None = L.ALPHABET,
    case_insensitive: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Occurrences of characters, most frequent first."""
    counts = L.filter_chars(L.char_counts(df, mode, by), chars, case_insensitive)
    if case_insensitive:
        counts = L.fold_case(counts, by)
    return counts.orderBy(*by, *order_of("count", ("first_post", "char")))


REPORTS: dict[str, Callable[..., DataFrame]] = {
    fn.__name__: fn
    for fn in (
        author_table,
        violation_table,
        emoji_table,
        top_share,
        yearly_top_share,
        emoji_share,
        emoji_distribution,
        top_mentioned,
        top_mentioners,
        top_quoted,
        top_quoters,
        forecast,
        forecast_summary,
        authors_per_year,
        messages_per_author_per_year,
        words_per_message,
        letters,
    )
}


def report(name: str, df: DataFrame, **options) -> DataFrame:
    """A report by its name; users add their own to ``REPORTS``."""
    if name not in REPORTS:
        raise ValueError(f"no report named {name}; there are {', '.join(REPORTS)}")
    return REPORTS[name](df, **options)
