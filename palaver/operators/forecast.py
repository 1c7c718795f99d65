"""When will a thread reach a number of posts?"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions.paging import POSTS_PER_PAGE
from palaver.operators.gaps import fill_gaps
from palaver.operators.select import filter_time_range, in_time_range
from palaver.session import shuffle_width

KINDS = ("post", "page", "timestamp")
SECONDS_PER_DAY = 86_400
LAST_DAY = (2**63 - 1) // (SECONDS_PER_DAY * 1_000_000)  # days since 1970 that a timestamp can hold
BLOCK = 10_000  # days generated from one array


def period_select(df: DataFrame, start: int, end: int, kind: str) -> DataFrame:
    """Posts of a period given in post numbers, page numbers or Unix times."""
    if kind not in KINDS:
        raise ValueError(f"the period type must be one of {', '.join(KINDS)}")
    if kind == "timestamp":
        return filter_time_range(df, start, end)
    return df.filter(F.col(f"{kind}_num").between(start, end))


def check_period(
    total: int,
    first_timestamp: int,
    last_timestamp: int,
    goal: int,
    start: int,
    end: int,
    kind: str,
) -> tuple[int, int]:
    """Validate the arguments against the data; times are clamped to it."""
    if type(start) is not int or type(end) is not int:
        raise TypeError("the period bounds must be integers")
    if kind not in KINDS:
        raise ValueError(f"the period type must be one of {', '.join(KINDS)}")
    if not total:
        raise ValueError("there are no posts to forecast from")
    if goal <= total:
        raise ValueError(f"the goal of {goal} is already reached")
    if kind == "timestamp":
        if start > last_timestamp:
            raise ValueError("the period starts after the last post")
        if end < first_timestamp:
            raise ValueError("the period ends before the first post")
        start, end = max(start, first_timestamp), min(end, last_timestamp)
    else:
        last = total if kind == "post" else math.ceil(total / POSTS_PER_PAGE)
        if not 1 <= start < last:
            raise ValueError(f"the period must start in 1..{last - 1}")
        if not 2 <= end <= last:
            raise ValueError(f"the period must end in 2..{last}")
    if start > end:
        raise ValueError("the period starts after its end")
    return start, end


def posting_rate(period: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """posts, seconds and posts per day of a period; no rate over 0 seconds."""
    span = F.unix_micros(F.max("creation_ts")) - F.unix_micros(F.min("creation_ts"))
    return (
        period.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.floor(span / 1_000_000).alias("seconds"),
            F.max("creation_local").alias("end_local"),
        )
        .withColumn(
            "posts_per_day",
            F.try_divide(F.col("posts"), F.col("seconds")) * SECONDS_PER_DAY,
        )
    )


def _in_range() -> Column:
    """Whether the end of the forecast still fits a timestamp."""
    return F.col("days") < LAST_DAY - 1 - F.unix_date(F.to_date("end_local"))


def days_to_goal(rate: DataFrame, total: Column, goal: int | Column) -> DataFrame:
    """Days until ``goal`` posts at the rate of the period, and the date it ends."""
    days = F.try_divide((goal if isinstance(goal, Column) else F.lit(goal)) - total, F.col("posts_per_day"))
    seconds = F.floor(F.col("days") * SECONDS_PER_DAY)
    eta = F.timestamp_add("SECOND", seconds, F.col("end_local"))
    return rate.withColumn("days", days).withColumn(
        "eta", F.when(_in_range(), eta)
    )


def daily_histogram(period: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posts of every calendar day from the first to the last, empty days too."""
    counts = period.groupBy(*by, F.to_date("creation_local").alias("day")).agg(
        F.count(F.lit(1)).alias("posts")
    )
    return fill_gaps(counts, "day", ["posts"], by)


def forecast_series(period: DataFrame, total: Column, goal: int) -> DataFrame:
    """The histogram, then one row a day at the mean rate until the goal.

    Nothing follows the histogram where the goal is reached already, or so far
    ahead that ``days_to_goal`` has no date for it.
    """
    past = daily_histogram(period).select(
        "day", F.col("posts").cast("double").alias("posts"), F.lit(False).alias("is_forecast")
    )
    open_goal = days_to_goal(posting_rate(period), total, goal).where((F.col("days") > 0) & _in_range())
    outlook = open_goal.select(
        F.ceil("days").cast("int").alias("ahead"),
        F.to_date("end_local").alias("last"),
        "posts_per_day",
    )
    return past.unionByName(_outlook_days(outlook))


def _outlook_days(outlook: DataFrame) -> DataFrame:
    """A row for each of the ``ahead`` days after ``last``.

    First a row for each slice of ``BLOCK`` days, then these are dealt to tasks,
    where their days are written out: no task gets a distant goal whole.
    """
    slices = F.sequence(F.lit(0), F.floor((F.col("ahead") - 1) / BLOCK).cast("int"))
    block = F.col("block") * BLOCK
    return (
        outlook.withColumn("block", F.explode(slices))
        .repartition(shuffle_width(outlook.sparkSession), "block")
        .withColumn("step", F.explode(F.sequence(block + 1, F.least(block + BLOCK, F.col("ahead")))))
        .select(
            F.date_add("last", F.col("step")).alias("day"),
            F.col("posts_per_day").alias("posts"),
            F.lit(True).alias("is_forecast"),
        )
    )


def _inside(start: int, end: int, kind: str) -> Column:
    """Whether a post lies in the period, as ``period_select`` has it."""
    if kind == "timestamp":
        return in_time_range(start, end)
    return F.col(f"{kind}_num").between(start, end)


def daily_facts(df: DataFrame, by: Sequence[str], start: int, end: int, kind: str) -> DataFrame:
    """A row for each group and day: posts in all and in the period, and their first and last times. The one pass over the posts."""
    if type(start) is not int or type(end) is not int:
        raise TypeError("the period bounds must be integers")
    if kind not in KINDS:
        raise ValueError(f"the period type must be one of {', '.join(KINDS)}")
    inside = F.coalesce(_inside(start, end, kind), F.lit(False))
    of_period = lambda c: F.when(inside, F.col(c))
    return df.groupBy(*by, F.to_date("creation_local").alias("day")).agg(
        F.count(F.lit(1)).alias("day_total"),
        F.count_if(inside).alias("day_posts"),
        F.min("creation_ts").alias("day_first"),
        F.max("creation_ts").alias("day_last"),
        F.min(of_period("creation_ts")).alias("period_first"),
        F.max(of_period("creation_ts")).alias("period_last"),
        F.max(of_period("creation_local")).alias("period_end"),
    )


#: Figures of a group over its rows of ``daily_facts``.
_GROUP = {
    "total": F.sum, "posts": F.sum, "first": F.min, "last": F.max, "period_first": F.min, "period_last": F.max, "end_local": F.max,
}
_OF_DAY = {"total": "day_total", "posts": "day_posts", "first": "day_first", "last": "day_last", "end_local": "period_end"}


def _judged(facts: DataFrame, goal: int | Column, start: int, end: int, kind: str) -> DataFrame:
    """Add ``goal``, ``seconds``, the rate, and ``problem``: why there is no forecast, by the rules of ``check_period``."""
    span = F.unix_micros("to") - F.unix_micros("from")
    facts = facts.withColumn("goal", goal if isinstance(goal, Column) else F.lit(goal))
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    problem = F.when(F.col("goal") <= F.col("total"), said("the goal of ", F.col("goal").cast("string"), " is already reached"))
    if kind == "timestamp":
        problem = problem.when(F.lit(start) > F.unix_seconds("last"), "the period starts after the last post").when(
            F.lit(end) < F.unix_seconds("first"), "the period ends before the first post"
        )
    else:
        last = F.col("total") if kind == "post" else F.ceil(F.col("total") / POSTS_PER_PAGE)
        problem = problem.when(
            ~F.lit(start).between(1, last - 1), said("the period must start in 1..", (last - 1).cast("string"))
        ).when(~F.lit(end).between(2, last), said("the period must end in 2..", last.cast("string")))
    problem = problem.when(F.lit(start) > F.lit(end), "the period starts after its end")
    return (
        facts.withColumn("seconds", F.floor(span / 1_000_000))
        .withColumn("posts_per_day", F.try_divide(F.col("posts"), F.col("seconds")) * SECONDS_PER_DAY)
        .withColumn("problem", problem)
    )


def _figures(over) -> dict[str, Column]:
    """The figures of ``_GROUP``, each made by ``over`` of an aggregate."""
    named = {name: over(fn(F.col(_OF_DAY.get(name, name)))) for name, fn in _GROUP.items()}
    return {{"period_first": "from", "period_last": "to"}.get(name, name): c for name, c in named.items()}


def group_facts(daily: DataFrame, by: Sequence[str], goal: int | Column, start: int, end: int, kind: str) -> DataFrame:
    """Each group's total, period, rate and goal, and the ``problem`` if there is no forecast for it."""
    facts = daily.groupBy(*by).agg(*[c.alias(name) for name, c in _figures(lambda c: c).items()])
    return _judged(facts, goal, start, end, kind)


def forecast_by(df: DataFrame, by: Sequence[str], goal: int | Column, start: int, end: int, kind: str) -> DataFrame:
    """``forecast_series`` of every group whose arguments hold; see ``group_facts`` for the others.

    ``goal`` is one number for all groups or an expression over a group's ``total``.
    Nothing is read on the driver, and posts are read once: windows over a group's
    days, not its posts, give the figures and the gaps. Days, past ones without posts
    and future ones, are written out slice by slice in tasks of their own.
    """
    daily = daily_facts(df, by, start, end, kind)
    group = W.partitionBy(*by)
    rows = _judged(daily.withColumns(_figures(lambda c: c.over(group))), goal, start, end, kind)
    rows = rows.where("problem is null and day_posts > 0").withColumn("next", F.lead("day").over(group.orderBy("day")))
    rows = days_to_goal(rows, F.col("total"), F.col("goal"))
    # A slice: its first day, the number of its days, and what stands in them.
    part = lambda first, days, ahead: F.struct(first.alias("first"), days.alias("days"), F.lit(ahead).alias("ahead"))
    reach = F.coalesce(F.datediff("next", "day"), F.lit(1))
    past = F.array(part(F.col("day"), reach, False))
    ahead = F.when((F.col("days") > 0) & _in_range(), F.ceil("days").cast("int"))
    blocks = F.sequence(F.lit(0), F.floor((ahead - 1) / BLOCK).cast("int"))
    last = F.to_date("end_local")
    future = F.transform(blocks, lambda k: part(F.date_add(last, k * BLOCK + 1), F.least(F.lit(BLOCK), ahead - k * BLOCK), True))
    slices = F.when(F.col("next").isNull() & ahead.isNotNull(), F.concat(past, future)).otherwise(past)
    dealt = rows.select(*by, "day_posts", "posts_per_day", F.explode(slices).alias("slice")).repartition(
        shuffle_width(df.sparkSession), *by, "slice"
    )
    step = F.explode(F.sequence(F.lit(0), F.col("slice.days") - 1))
    posts = F.when(F.col("slice.ahead"), F.col("posts_per_day")).otherwise(
        F.when(F.col("step") == 0, F.col("day_posts")).otherwise(0).cast("double")
    )
    return dealt.withColumn("step", step).select(
        *by,
        F.date_add("slice.first", F.col("step")).alias("day"),
        posts.alias("posts"),
        F.col("slice.ahead").alias("is_forecast"),
    )
