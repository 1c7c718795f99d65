"""Forecast: periods, argument checks, rates, histogram and series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from palaver.operators import forecast as FC
from palaver.plans import reports

START = dt.datetime(2021, 3, 1, 22)
# Post k comes 7k hours after the first; 50 posts on 3 pages.
TIMES = [START + dt.timedelta(hours=7 * k) for k in range(50)]


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(k + 1, k // 20 + 1, t, t) for k, t in enumerate(TIMES)]
    schema = (
        "post_num long, page_num int, creation_ts timestamp, creation_local timestamp_ntz"
    )
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def epoch(time):
    return int(time.replace(tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize(
    "start, end, kind, chosen",
    [
        (5, 20, "post", TIMES[4:20]),
        (2, 3, "page", TIMES[20:50]),
        (epoch(TIMES[3]), epoch(TIMES[9]), "timestamp", TIMES[3:10]),
        (0, 2**40, "timestamp", TIMES),
    ],
)
def test_forecast(posts, start, end, kind, chosen):
    goal = 120
    seconds = int((chosen[-1] - chosen[0]).total_seconds())
    per_day = len(chosen) / seconds * 86_400
    days = (goal - 50) / per_day
    summary = reports.forecast_summary(posts, goal, start, end, kind, "(alles)").first()
    assert summary.title == "Prognose: 120 (alles)"
    assert (summary.posts, summary.seconds) == (len(chosen), seconds)
    assert summary.posts_per_day == pytest.approx(per_day)
    assert summary.days == pytest.approx(days)
    eta = chosen[-1] + dt.timedelta(days=days)
    assert abs((summary.eta - eta).total_seconds()) < 2

    rows = reports.forecast(posts, goal, start, end, kind).collect()
    past = [r for r in rows if not r.is_forecast]
    future = [r for r in rows if r.is_forecast]
    first, last = chosen[0].date(), chosen[-1].date()
    assert [r.day for r in past] == [
        first + dt.timedelta(days=i) for i in range((last - first).days + 1)
    ]
    assert [r.posts for r in past] == [
        sum(t.date() == r.day for t in chosen) for r in past
    ]
    assert len(future) == math.ceil(days)
    assert [r.day for r in future] == [
        last + dt.timedelta(days=i + 1) for i in range(len(future))
    ]
    assert all(r.posts == pytest.approx(per_day) for r in future)


@pytest.mark.parametrize(
    "goal, start, end, kind, error",
    [
        (50, 1, 5, "post", ValueError),
        (99, 1.0, 5, "post", TypeError),
        (99, 1, "5", "post", TypeError),
        (99, 1, 5, "day", ValueError),
        (99, 0, 5, "post", ValueError),
        (99, 50, 50, "post", ValueError),
        (99, 1, 1, "post", ValueError),
        (99, 1, 51, "post", ValueError),
        (99, 9, 5, "post", ValueError),
        (99, 3, 3, "page", ValueError),
        (99, 1, 4, "page", ValueError),
        (99, 2**40, 2**41, "timestamp", ValueError),
        (99, 0, 5, "timestamp", ValueError),
        (99, epoch(TIMES[9]), epoch(TIMES[3]), "timestamp", ValueError),
    ],
)
def test_refused_arguments(posts, goal, start, end, kind, error):
    with pytest.raises(error):
        reports.forecast(posts, goal, start, end, kind)


def test_empty_days_count_zero(posts):
    period = posts.filter(F.col("post_num").isin(1, 2, 50))
    rows = FC.daily_histogram(period).orderBy("day").collect()
    assert sum(r.posts for r in rows) == 3
    assert len(rows) == (TIMES[49].date() - TIMES[0].date()).days + 1
    assert {r.posts for r in rows} == {0, 1}


def test_by_thread(posts):
    halves = posts.withColumn("thread_id", F.when(F.col("post_num") <= 20, "a").otherwise("b"))
    rates = {r.thread_id: r for r in FC.posting_rate(halves, ["thread_id"]).collect()}
    assert (rates["a"].posts, rates["b"].posts) == (20, 30)
    days = FC.daily_histogram(halves, ["thread_id"]).collect()
    for thread, times in (("a", TIMES[:20]), ("b", TIMES[20:])):
        got = {r.day: r.posts for r in days if r.thread_id == thread}
        assert len(got) == (times[-1].date() - times[0].date()).days + 1
        assert all(n == sum(t.date() == d for t in times) for d, n in got.items())


def test_last_post_at_midnight_has_its_day(spark):
    times = [dt.datetime(2021, 1, 1, 12), dt.datetime(2021, 1, 2)]
    df = spark.createDataFrame([(t,) for t in times], "creation_local timestamp_ntz")
    rows = FC.daily_histogram(df).orderBy("day").collect()
    assert [r.posts for r in rows] == [1, 1]


def test_no_time_passed(posts):
    """One instant gives no rate: the summary says so and nothing is forecast."""
    period = posts.filter("post_num = 3")
    outlook = FC.days_to_goal(FC.posting_rate(period), F.lit(50), 99).first()
    assert (outlook.posts_per_day, outlook.days, outlook.eta) == (None, None, None)
    series = FC.forecast_series(period, F.lit(50), 99).collect()
    assert [r.is_forecast for r in series] == [False]


def test_distant_goal(posts):
    """More days than one generated block, none of them lost."""
    period = posts.filter("post_num <= 20")
    outlook = FC.days_to_goal(FC.posting_rate(period), F.lit(50), 100_000).first()
    series = FC.forecast_series(period, F.lit(50), 100_000).filter("is_forecast")
    assert outlook.days > FC.BLOCK
    stats = series.agg(F.count("*"), F.count_distinct("day")).first()
    assert stats[0] == stats[1] == math.ceil(outlook.days)


def test_period_filters_reach_the_scan(posts, spark, tmp_path):
    path = str(tmp_path / "p")
    posts.write.parquet(path)
    df = FC.period_select(spark.read.parquet(path), 5, 9, "post")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(post_num,5), LessThanOrEqual(post_num,9)" in plan


@pytest.mark.parametrize("goal", [1, 50, 2**62])
def test_series_ends_with_the_histogram_if_no_day_is_ahead(posts, goal):
    series = FC.forecast_series(posts, F.lit(50), goal).collect()
    assert series and not any(r.is_forecast for r in series)
    (rate,) = FC.days_to_goal(FC.posting_rate(posts), F.lit(50), goal).collect()
    assert (rate.eta is None) == (goal > 50)
