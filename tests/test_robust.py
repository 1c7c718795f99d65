"""Cases that no supplied table reaches: odd times and likes, other page sizes, NULL keys, other schemas."""

import pytest
from palaver.functions.maps import tagged_entries
from palaver.functions.times import instant_of_iso, local_of_iso
from palaver.operators import references as R
from palaver.operators.occurrences import appearance, seen_at
from palaver.operators.select import filter_post_range
from palaver.plans import markup, views
from palaver.sources.pages import _likes, extract_posts
from palaver.sources.posts import latest_version, read_posts
from pyspark.sql import functions as F


def test_times_with_fraction_or_without_seconds(spark):
    texts = ["2020-05-11T18:22:33.123+0200", "2020-05-11T18:22+02:00", "2020-05-11T18:22:33Z", "2020-05-11", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(instant_of_iso(F.col("t")).cast("string"), local_of_iso(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == ["2020-05-11 16:22:33.123", "2020-05-11 16:22:00", "2020-05-11 18:22:33", None, None]
    assert [r[1] for r in got][:3] == ["2020-05-11 18:22:33.123", "2020-05-11 18:22:00", "2020-05-11 18:22:33"]


def test_likes_beyond_the_type_are_null(spark):
    rows = [(3, "and 5 others"), (3, "and 99999999999 others"), (3, "and 2147483647 others"), (3, None), (1, "999999999999")]
    df = spark.createDataFrame(rows, "n int, t string")
    assert [r[0] for r in df.select(_likes(F.col("n"), F.col("t"))).collect()] == [8, None, None, 3, 1]


def test_post_range_does_not_hang_on_page_size(spark):
    df = spark.range(1, 101).selectExpr("id as post_num", "cast(ceil(id / 25) as int) as page_num")
    assert filter_post_range(df, range(21, 101)).count() == 80


def test_latest_version_keeps_null_keys_and_versions(spark):
    rows = [("t", 1, None, "a"), ("t", None, None, "b"), (None, 1, None, None), ("u", 1, None, None)]
    df = spark.createDataFrame(rows, "thread_id string, page_num int, ingested_at timestamp, source_path string")
    assert latest_version(df).count() == 4
    one = spark.createDataFrame([(1, 5), (1, None), (2, None)], "k int, v int")
    assert sorted(map(tuple, latest_version(one, ("k",), ("v",)).collect())) == [(1, 5), (2, None)]


def test_other_schemas_are_refused(spark, tmp_path):
    from palaver.schema import POSTS_SCHEMA

    good = spark.createDataFrame([], POSTS_SCHEMA)
    good.withColumn("post_num", F.col("post_num").cast("string")).write.parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="post_num"):
        read_posts(spark, f"{tmp_path}/p")
    names = ", ".join(f'"{n}": null' for n in POSTS_SCHEMA.names)
    spark.createDataFrame([("{" + names + "}",), ('{"foo": 1}',)], "value string").coalesce(1).write.text(f"{tmp_path}/j")
    with pytest.raises(ValueError, match="not a posts table"):
        read_posts(spark, f"{tmp_path}/j", "json")


def test_ties_rank_by_first_appearance_at_any_position_and_number(spark):
    """Neither 2^20 positions nor 2^43 posts run into the next post or out of the type."""
    late = (1 << 20) + 5
    long = spark.range(1).select(
        F.lit(1).cast("bigint").alias("post_num"),
        F.transform(F.sequence(F.lit(0), F.lit(late)), lambda i: F.when(i == late, F.lit("far")).otherwise(F.lit("0"))).alias("mentioned_list"),
    )
    rows = [(2, ["next", "next"]), (1 << 43, ["huge"]), ((1 << 63) - 1, ["0", "last"]), (None, ["never"]), (3, None), (4, [])]
    posts = long.unionByName(spark.createDataFrame(rows, "post_num bigint, mentioned_list array<string>"))
    times = R.times_mentioned(posts)
    got = times.orderBy(F.col("first_seen").asc_nulls_last()).select("user_id", "times", *seen_at()).collect()
    assert [tuple(r) for r in got] == [
        ("far", 1, 1, late),
        ("next", 2, 2, 0),
        ("huge", 1, 1 << 43, 0),
        ("last", 1, (1 << 63) - 1, 1),
        ("never", 1, None, None),
    ]


def test_first_appearance_stays_in_a_hash_aggregate(spark):
    rows = spark.range(10).selectExpr("id as post_num", "1 as pos", "id % 3 as k")
    plan = rows.groupBy("k").agg(F.min(appearance()).alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_entries_of_lists_and_maps(spark):
    rows = [(1, ["a", None], {"x": 2}), (2, None, {}), (3, [], None), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, l array<string>, m map<string,int>")
    entries = F.explode(tagged_entries({"list": F.col("l")}, {"map": F.col("m")}))
    got = df.select("id", entries.alias("e")).select("id", "e.*").collect()
    assert [tuple(r) for r in got] == [(1, "list", "a", 1), (1, "list", None, 1), (1, "map", "x", 2)]


@pytest.mark.parametrize("few", [True, False])
def test_names_of_few_ids_equal_those_of_all(spark, few):
    rows = [("1", "late", 9), ("1", "early", 2), ("2", "b", 1), ("0", "nobody", 1), (None, "x", 1)]
    posts = spark.createDataFrame(rows, "author_id string, author string, post_num bigint")
    ids = spark.createDataFrame([("1",), ("0",), ("7",)], "user_id string")
    got = R.lookup_author_name(ids, posts, few=few).collect()
    assert {r.user_id: r["name"] for r in got} == {"1": "early", "0": "0", "7": "7"}


def test_tables_are_printed_by_report_name(spark):
    posts = spark.createDataFrame(
        [(n, a, ok) for n, (a, ok) in enumerate([("x", True), ("y", False), ("x", False), ("y", False)])],
        "post_num bigint, author string, is_rules_compliant boolean",
    )
    lines = [r.line for r in markup.printable("violation_table", views.as_posts(posts), n=1).collect()]
    assert lines[0].startswith("[TABLE=full]") and lines[-1] == "[/TABLE]"
    assert lines[1:-1] == [
        "[TR][TD]x[/TD][TD]2[/TD][TD]1[/TD][TD]50.0%[/TD][/TR]",
        "[TR][TD]y[/TD][TD]2[/TD][TD]2[/TD][TD]100.0%[/TD][/TR]",
    ]
    for name, options in (("letters", {}), ("author_table", {"by": ["thread_id"]})):
        with pytest.raises(ValueError):
            markup.printable(name, posts, **options)


def test_pages_outside_a_range_are_not_parsed(spark):
    """A page that would fail the job if it was parsed stands outside the ranges."""
    pages = views.with_page_origin(views.thread_pages(spark, "/root/testdata/sf0.001", long=True))
    bad = F.when(F.col("page_num") == 1, F.raise_error(F.lit("parsed"))).otherwise(F.col("html"))
    pages = pages.withColumn("html", bad)
    assert extract_posts(pages, page_range=range(2, 100)).count() > 0
    assert extract_posts(pages, post_range=range(21, 2000)).count() > 0
    with pytest.raises(Exception, match="parsed"):
        extract_posts(pages, page_range=range(1, 2)).count()
