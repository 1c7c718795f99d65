"""Posts at rest, report files, versions and incremental ingest."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from test_extraction import frame, post

from palaver.operators.select import filter_time_range
from palaver.plans import markup, reports, views
from palaver.sources.pages import extract_posts, read_packed_pages, write_pages
from palaver.sources.posts import (
    concat_parts,
    latest_version,
    read_posts,
    write_posts,
    write_report,
)
from palaver.streaming.ingest import ingest_pages, ingested_problems

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def posts(spark):
    emojis = '<img class="smilie" data-shortname=":s:">'
    pages = frame(
        spark, post(f"Eins zwei {emojis}"), post("", post_id="post-8", number="#2", user="")
    )
    return extract_posts(pages).cache()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
@pytest.mark.parametrize("cluster", [False, True])
def test_posts_round_trip(spark, posts, tmp_path, fmt, cluster):
    path = str(tmp_path / "posts")
    write_posts(posts, path, fmt, cluster=cluster)
    again = read_posts(spark, path, fmt)
    assert again.schema == posts.schema or [f.dataType for f in again.schema] == [
        f.dataType for f in posts.schema
    ]
    order = lambda df: sorted(df.collect(), key=lambda r: r.post_num)
    assert order(again) == order(posts)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_other_tables_are_refused(spark, posts, tmp_path, fmt):
    path = str(tmp_path / "other")
    other = posts.select(*posts.columns[1:], posts.columns[0])
    other.write.format(fmt).option("ignoreNullFields", "false").save(path)
    with pytest.raises(ValueError):
        read_posts(spark, path, fmt)
    with pytest.raises(ValueError):
        write_posts(other, str(tmp_path / "x"))
    for call in (lambda: read_posts(spark, path, "csv"), lambda: write_posts(posts, path, "csv")):
        with pytest.raises(ValueError):
            call()


def test_time_filter_skips_row_groups(spark, tmp_path):
    """Instants are stored with statistics, and the filter is pushed to the scan."""
    path = str(tmp_path / "posts")
    documents = views.doc(spark, SF_DIR).withColumn(
        "creation_ts", F.col("creation_local").cast("timestamp")
    )
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    write_posts(views.as_posts(documents), path, cluster=True)
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == before
    df = filter_time_range(read_posts(spark, path), 1_580_000_000, 1_580_100_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(creation_ts" in plan
    import pyarrow.parquet as pq

    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    meta = pq.ParquetFile(f"{path}/{name}").metadata
    column = meta.schema.names.index("creation_ts")
    assert meta.row_group(0).column(column).statistics.has_min_max


def test_report_files(spark, posts, tmp_path):
    documents = views.doc(spark, SF_DIR)
    table = reports.author_table(documents)
    for ending in ("csv", "json", "parquet"):
        path = str(tmp_path / f"r.{ending}")
        write_report(table, path)
        reader = spark.read.option("header", "true").format(ending)
        assert reader.load(path).count() == table.count()
    lines = markup.markup_table(table, markup.AUTHOR_HEADINGS, markup.by_messages())
    path = str(tmp_path / "r.txt")
    write_report(lines, path)
    # Part files in order of their names are the table from first line to last.
    text = ""
    for name in sorted(n for n in os.listdir(path) if n.startswith("part-")):
        text += open(f"{path}/{name}", encoding="utf-8").read()
    assert text.splitlines() == [r.line for r in lines.collect()]
    with pytest.raises(ValueError):
        write_report(table, str(tmp_path / "r.svg"))


def test_concat_parts(spark, posts):
    whole = concat_parts(posts.filter("post_num = 2"), posts.filter("post_num = 1"))
    assert [r.post_num for r in whole.collect()] == [1, 2]


def test_latest_version_of_a_hot_key(spark):
    rows = [("k", 1, v % 9, f"p{v % 2}", v) for v in range(600)]
    rows += [("k", n, 1, "p", n) for n in range(2, 300)]
    schema = "thread_id string, page_num int, ingested_at int, source_path string, x int"
    df = spark.createDataFrame(rows, schema).repartition(6)
    got = latest_version(df).collect()
    expected = [r for r in rows if r[1] > 1 or (r[2] == 8 and r[3] == "p1")]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def land(folder, pages):
    for (thread, page), html in pages.items():
        os.makedirs(folder / thread, exist_ok=True)
        (folder / thread / f"page_{page:04d}.html").write_text(html, "utf-8")


def contents(posts):
    rows = latest_version(posts).collect()
    return {(r.thread_id, r.post_num): r.content for r in rows}


def test_ingest(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    one, two = post("eins"), post("zwei", number="#2", post_id="post-8")
    three = post("drei", number="#3", post_id="post-9")
    land(landing / "b1", {("a", 1): one, ("b", 1): one + post(post_id="bad")})
    first = ingest_pages(spark, str(landing), out)
    assert contents(first) == {("a", 1): "eins", ("b", 1): "eins"}
    assert [r.problems for r in ingested_problems(spark, out).collect()] == [["post_id"]]
    # Nothing new: nothing is added.
    assert ingest_pages(spark, str(landing), out).count() == 2
    # The newest page has grown, one of its posts was edited, another page is new.
    grown = one.replace("eins", "EINS") + two
    land(landing / "b2", {("a", 1): grown, ("a", 2): three})
    for f in (landing / "b2" / "a").iterdir():
        os.utime(f, (4_000_000_000, 4_000_000_000))
    second = ingest_pages(spark, str(landing), out)
    assert second.count() == 5
    assert contents(second) == {
        ("a", 1): "EINS",
        ("a", 2): "zwei",
        ("a", 3): "drei",
        ("b", 1): "eins",
    }


def test_packed_ingest_in_small_batches(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for n in range(3):
        page = frame(spark, post(f"nr {n}", number=f"#{n + 1}"), page=n + 1)
        write_pages(page, f"{landing}/b{n}")
    posts = ingest_pages(spark, landing, out, packed=True, max_files=1)
    assert sorted(r.content for r in posts.collect()) == ["nr 0", "nr 1", "nr 2"]
    assert read_packed_pages(spark, landing).count() == 3


def test_repeated_batch_replaces_its_output(spark, tmp_path):
    """A batch run again after a failure must not store its posts twice."""
    landing, out = tmp_path / "landing", tmp_path / "out"
    land(landing / "b1", {("a", 1): post("eins")})
    assert ingest_pages(spark, str(landing), str(out)).count() == 1
    (commit,) = [f for f in (out / "progress" / "commits").iterdir() if f.name == "0"]
    commit.rename(tmp_path / "commit0")
    crc = commit.with_name(".0.crc")
    crc.rename(tmp_path / "crc0")
    assert ingest_pages(spark, str(landing), str(out)).count() == 1


def test_views_are_posts_tables(spark):
    for view in (views.doc, views.evt, views.emo, views.ord_):
        assert views.as_posts(view(spark, SF_DIR)).count() > 0
    assert dt.datetime(2020, 1, 1) == views.doc(spark, SF_DIR).agg(
        F.min("creation_local")
    ).first()[0]
