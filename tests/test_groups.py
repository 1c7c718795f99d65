"""Forecasts of many threads in one job, and letters by group."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palaver.operators import forecast as FC
from palaver.operators import letters as L
from palaver.plans import reports
from test_forecast import TIMES, epoch

SCHEMA = "thread_id string, post_num long, page_num int, creation_ts timestamp, creation_local timestamp_ntz"
LENGTHS = {"a": 50, "b": 31, None: 44, "short": 3, "one": 1}


@pytest.fixture(scope="module")
def threads(spark):
    rows = [(t, k + 1, k // 20 + 1, TIMES[k], TIMES[k]) for t, n in LENGTHS.items() for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def series(df):
    return sorted((r.day, round(r.posts, 9), r.is_forecast) for r in df.collect())


@pytest.mark.parametrize(
    "goal, start, end, kind",
    [(120, 5, 20, "post"), (45, 1, 2, "page"), (60, epoch(TIMES[3]), epoch(TIMES[29]), "timestamp"), (2, 1, 2, "post"), (99, 9, 5, "post")],
)
def test_every_thread_as_if_alone(threads, goal, start, end, kind):
    got = reports.forecast(threads, goal, start, end, kind, by=["thread_id"]).cache()
    problems = {r.thread_id: r.problem for r in reports.forecast_problems(threads, goal, start, end, kind, ["thread_id"]).collect()}
    for thread in LENGTHS:
        own = threads.where(F.col("thread_id").eqNullSafe(F.lit(thread)))
        mine = series(got.where(F.col("thread_id").eqNullSafe(F.lit(thread))))
        try:
            assert mine == series(reports.forecast(own, goal, start, end, kind)) and thread not in problems
        except ValueError as e:
            assert not mine and problems[thread] == str(e)


def test_a_goal_for_each_thread(threads):
    got = reports.forecast(threads.where("thread_id in ('a', 'b')"), 2 * F.col("total"), 1, 20, "post", by=["thread_id"])
    for thread in "ab":
        own = threads.where(F.col("thread_id") == thread)
        assert series(got.where(F.col("thread_id") == thread)) == series(reports.forecast(own, 2 * LENGTHS[thread], 1, 20, "post"))
    with pytest.raises(TypeError):
        reports.forecast(threads, 120, 1.0, 20, "post", by=["thread_id"])
    with pytest.raises(ValueError):
        reports.forecast(threads, 120, 1, 20, "day", by=["thread_id"])
    assert reports.forecast(threads.limit(0), 120, 1, 20, "post", by=["thread_id"]).count() == 0


def test_days_of_a_distant_goal_are_dealt_in_slices(threads):
    far = FC.forecast_by(threads.where("thread_id = 'a'"), ["thread_id"], 1_000_000, 1, 20, "post").where("is_forecast")
    sizes = [len(p) for p in far.rdd.glom().collect() if p]
    assert sum(sizes) > 20 * FC.BLOCK and max(sizes) < sum(sizes) / 2


def test_one_pass_over_the_posts(spark, threads, tmp_path):
    threads.write.parquet(str(tmp_path / "posts"))
    df = reports.forecast(spark.read.parquet(str(tmp_path / "posts")), 120, 5, 20, "post", by=["thread_id"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1


def test_letters_by_group(spark):
    rng = random.Random(7)
    words = ["Aß", "b", "ä𝕏", "zź", "日本", "a" * 40, "Z"]
    rows = [
        (rng.choice(["s", "t", None]), rng.choice([1, 2, None]), rng.choice([None, *range(90)]), rng.choices(words, k=rng.randrange(5)) if k % 9 else None)
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, "thread_id string, year int, post_num long, words array<string>").repartition(3)
    pick = {"count_all": lambda w: w, "count_first": lambda w: w[:1], "count_last": lambda w: w[-1:]}
    for mode in L.MODES:
        for by in ([], ["thread_id"], ["thread_id", "year"]):
            counts, first = Counter(), {}
            for thread, year, post, held in rows:
                group = (thread, year)[: len(by)]
                for char in "".join(pick[mode](w) for w in held or []):
                    counts[(*group, char)] += 1
                    first.setdefault((*group, char), []).append(post)
            want = {k: (n, min((p for p in first[k] if p is not None), default=None)) for k, n in counts.items()}
            got = L.char_counts(df, mode, by).collect()
            assert {(*[r[c] for c in by], r.char): (r["count"], r.first_post) for r in got} == want and len(got) == len(want)
