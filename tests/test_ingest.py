"""Copies of pages: the manifest, what is alive, compaction, and pages that cannot be read to their end."""

import os

import pytest
from pyspark.sql import functions as F
from test_extraction import frame, post
from test_storage import land

from palaver.sources.pages import extract, extract_posts, quarantined
from palaver.streaming import ingest as I


def later(folder, seconds=4_000_000_000):
    for f in folder.rglob("*.html"):
        os.utime(f, (seconds, seconds))


def contents(df):
    return sorted((r.thread_id, r.page_num, r.post_num, r.content) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    """Three pages of thread a; the second copy of page 1 grew, of page 2 is empty, of page 3 unreadable."""
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    one, two, three = (post(x, number=f"#{k}", post_id=f"post-{k}") for k, x in ((1, "eins"), (2, "zwei"), (3, "drei")))
    land(landing / "b1", {("a", 1): one, ("a", 2): two, ("a", 3): three, ("b", 1): one})
    I.ingest_pages(spark, str(landing), out)
    land(landing / "b2", {("c", 1): one})
    I.ingest_pages(spark, str(landing), out)
    land(landing / "b3", {("a", 1): one.replace("eins", "EINS"), ("a", 2): "<p>gone</p>", ("a", 3): post("x", post_id="bad")})
    later(landing / "b3")
    I.ingest_pages(spark, str(landing), out)
    return out


LIVE = [("a", 1, 1, "EINS"), ("b", 1, 1, "eins"), ("c", 1, 1, "eins")]


def test_newest_copies_decide(spark, table):
    assert contents(I.live_posts(spark, table)) == LIVE
    assert I.ingested_posts(spark, table).count() == 6
    pages = {(r.thread_id, r.page_num, r.page_messages) for r in I.ingested_pages(spark, table).collect()}
    assert pages == {("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1), ("c", 1, 1), ("a", 2, 0)}
    assert [r.problems for r in I.live_problems(spark, table).collect()] == [["post_id"]]
    plan = I.live_posts(spark, table)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "content" in line]
    assert not wide, "posts are not shuffled to find out which are alive"


def test_compaction(spark, table):
    assert I.compact(spark, table) == 1
    assert contents(I.ingested_posts(spark, table)) == contents(I.live_posts(spark, table)) == LIVE
    assert I.ingested_pages(spark, table).count() == 5 and I.superseded_pages(I.ingested_pages(spark, table)).count() == 0
    assert [r.problems for r in I.ingested_problems(spark, table).collect()] == [["post_id"]]
    assert I.compact(spark, table) == 0
    assert I.vacuum(spark, table) == 1 and contents(I.ingested_posts(spark, table)) == LIVE


def test_compaction_goes_on_with_what_lands(spark, table, tmp_path):
    I.compact(spark, table)
    landing = tmp_path / "landing"
    land(landing / "b4", {("b", 1): "<p></p>", ("a", 2): post("wieder", number="#2", post_id="post-2")})
    later(landing / "b4", 4_100_000_000)
    I.ingest_pages(spark, str(landing), table)
    want = [("a", 1, 1, "EINS"), ("a", 2, 2, "wieder"), ("c", 1, 1, "eins")]
    assert contents(I.live_posts(spark, table)) == want
    assert I.compact(spark, table) == 2
    assert contents(I.ingested_posts(spark, table)) == want
    assert I.vacuum(spark, table) >= 3 and contents(I.ingested_posts(spark, table)) == want


def test_failure_before_the_snapshot_changes_nothing(spark, table, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(I, "publish", fail)
        with pytest.raises(OSError):
            I.compact(spark, table)
    assert I.ingested_posts(spark, table).count() == 6 and contents(I.live_posts(spark, table)) == LIVE
    # A snapshot without its end mark counts for nothing either.
    os.makedirs(f"{table}/snapshots/1")
    assert I.ingested_posts(spark, table).count() == 6
    os.rmdir(f"{table}/snapshots/1")
    assert I.compact(spark, table) == 1 and contents(I.ingested_posts(spark, table)) == LIVE


def test_empty_table(spark, tmp_path):
    out = str(tmp_path / "none")
    assert I.live_posts(spark, out).count() == 0 and I.compact(spark, out) == 0 and I.vacuum(spark, out) == 0


def test_pages_that_break_off(spark):
    whole = post("eins") + post("zwei", number="#2", post_id="post-8")
    third = post("drei", number="#3", post_id="post-9")
    half = third[: third.rindex("</article>")]
    pages = frame(spark, whole + "<![odd[ and more")
    assert [r.content for r in extract_posts(pages).orderBy("post_num").collect()] == ["eins", "zwei"]
    assert [(r.post_num, r.problems) for r in quarantined(extract(pages)).collect()] == [(None, ["page: broken markup"])]
    cut = frame(spark, whole + half + "<![odd[")
    assert extract_posts(cut).count() == 2
    rows = quarantined(extract(cut)).orderBy(F.col("post_num").asc_nulls_first()).collect()
    assert [(r.post_num, r.problems) for r in rows] == [(None, ["page: broken markup"]), (3, ["cut"])]
    missing = pages.withColumn("html", F.lit(None).cast("string"))
    assert [(r.thread_id, r.problems) for r in quarantined(extract(missing)).collect()] == [(pages.first().thread_id, ["page: no html"])]
    assert extract(frame(spark, "")).count() == 0
