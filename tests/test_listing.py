"""Thread folders are listed by a bounded number of tasks."""

from palaver.sources import pages as P

KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def test_folders_share_listing_tasks(spark, tmp_path):
    folders = 2 * P.LISTING_TASKS * spark.sparkContext.defaultParallelism + 33
    for k in range(folders):
        (tmp_path / f"thread-{k}").mkdir()
        (tmp_path / f"thread-{k}" / "page_0001.html").write_text("<html></html>")
    before = spark.conf.get(KEY)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        pages = P.read_pages(spark, str(tmp_path), recursive=True)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= P.LISTING_TASKS * spark.sparkContext.defaultParallelism
    assert pages.select("thread_id").distinct().count() == folders
    assert spark.conf.get(KEY) == before
