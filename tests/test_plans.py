"""What the physical plans must look like, whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

from palaver.operators import years as Y
from palaver.operators.ranking import top_n
from palaver.plans import reports, views
from palaver.plans.catalog import QUERIES
from palaver.session import scratch_path, spread
from palaver.sources.posts import latest_version, read_posts, write_posts

SF_DIR = "/root/testdata/sf0.001"
THREAD = ["thread_id"]


@pytest.fixture(scope="module")
def posts(spark):
    path = scratch_path(spark, "plan-posts")
    write_posts(views.as_posts(views.doc(spark, SF_DIR)), path)
    return read_posts(spark, path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


REPORTS = {
    "author_table": lambda p: reports.author_table(p),
    "author_table by": lambda p: reports.author_table(p, by=THREAD),
    "violation_table": lambda p: reports.violation_table(p),
    "top_share": lambda p: reports.top_share(p),
    "top_share by": lambda p: reports.top_share(p, by=THREAD),
    "yearly_top_share": lambda p: reports.yearly_top_share(p),
    "yearly_top_share by": lambda p: reports.yearly_top_share(p, by=THREAD),
    "emoji_table": lambda p: reports.emoji_table(p),
    "emoji_share": lambda p: reports.emoji_share(p),
    "emoji_distribution": lambda p: reports.emoji_distribution(p),
    "top_mentioned": lambda p: reports.top_mentioned(p),
    "top_mentioners": lambda p: reports.top_mentioners(p),
    "top_quoted": lambda p: reports.top_quoted(p),
    "authors_per_year": lambda p: reports.authors_per_year(p),
    "words_per_message": lambda p: reports.words_per_message(p),
    "letters": lambda p: reports.letters(p),
}


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_no_cartesian_and_few_columns(posts, name):
    plan = plan_of(REPORTS[name](posts))
    assert "Python" not in plan and "Arrow" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan):
        assert "content" not in schema
        assert schema.count(":") <= 6


@pytest.mark.parametrize("name", REPORTS)
def test_windows_see_aggregated_rows_only(posts, name):
    """Below every window there is an aggregate, and so no raw row."""
    lines = plan_of(REPORTS[name](posts)).split("\n")
    depth = [re.search(r"[A-Za-z(*]", line).start() if line.strip() else 0 for line in lines]
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = []
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                below.append(lines[j])
            text = "\n".join(below)
            assert "HashAggregate" in text
            assert text.index("HashAggregate") < text.index("FileScan")


@pytest.mark.parametrize("name", ["author_table", "top_mentioners", "letters", "emoji_table"])
def test_every_aggregate_is_partial_first(posts, name):
    plan = plan_of(REPORTS[name](posts))
    assert "partial_" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_groups_are_cut_before_the_shuffle(posts):
    plan = plan_of(Y.yearly_top_n(posts, 10))
    partial = plan.index("Partial", plan.index("WindowGroupLimit"))
    assert "WindowGroupLimit" in plan and partial > 0


def test_large_n_is_ranked_in_slices(posts):
    plan = plan_of(Y.yearly_top_n(posts, 2000))
    assert len(re.findall(r"\bWindow \[", plan)) == 2 and "_slice" in plan


def test_top_n_of_all_needs_no_global_sort(spark, posts):
    stats = posts.groupBy("author").agg(F.count("*").alias("messages"))
    plan = plan_of(top_n(stats, "messages", 5, ("author",)))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_aggregates_are_shuffled_once(spark, posts):
    """Totals, shares and the remainder read the same shuffle of the posts."""
    emojis = views.as_posts(views.emo(spark, SF_DIR))
    for name in ("top_share", "top_share by", "yearly_top_share", "emoji_distribution"):
        df = REPORTS[name](emojis if name.startswith("emoji") else posts)
        df.collect()
        final = plan_of(df).split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final, name


def test_names_are_aggregated_for_the_top_ids_only(posts):
    """The posts meet the n ids in a broadcast before any name is shuffled."""
    plan = plan_of(reports.top_mentioned(posts, n=5))
    names = plan[plan.index("partial_min(post_num"):]
    assert names.index("LeftSemi") < names.index("FileScan")
    assert "BroadcastHashJoin" in names[: names.index("FileScan")]


def test_entries_take_one_parse(spark):
    assert plan_of(QUERIES["extract_lists"](spark, SF_DIR)).count("MapInArrow") == 1
    assert plan_of(QUERIES["filter_unknown"](spark, SF_DIR)).count("FileScan") == 1


def test_latest_version_shuffles_wide_rows_at_most_once(spark, posts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(latest_version(posts))
        wide = [
            line
            for line in plan.split("\n")
            if "Exchange hashpartitioning(thread_id" in line and "page_num" in line
        ]
        # One for the posts, one for the versions, one for their maximum.
        assert len(wide) == 3
        below = plan[plan.rindex("SortAggregate"):]
        assert "HashAggregate" in below, "versions are hashed before they are sorted"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_spread_leaves_large_scans_alone(spark, tmp_path):
    many = str(tmp_path / "many")
    spark.range(100).repartition(40).write.parquet(many)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        df = spread(spark.read.parquet(many), "id")
        assert "Exchange" not in plan_of(df)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    one = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(one)
    assert "Exchange" in plan_of(spread(spark.read.parquet(one), "id"))
