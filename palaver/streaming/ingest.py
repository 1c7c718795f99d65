"""Process pages as they land, each file once, and keep what is stored small.

Layout of ``out``:

* ``extracted/batch_id=N/is_page=false|true`` — posts, and a row for every parsed page: the manifest.
* ``compacted/ID/batch_id=N/is_page=…`` — the same for batches rewritten without superseded copies.
* ``snapshots/K`` — which batches are read from which compaction. The newest one that was written to
  its end holds, so a compaction takes effect in one step or not at all.
* ``progress`` — the stream's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.schema import EXTRACTED_SCHEMA, PAGES_SCHEMA
from palaver.sources.pages import (
    FILE_NAME_DIGITS,
    FOLDER_PATTERN,
    PACKED_SCHEMA,
    accepted,
    extract_messages,
    packed_page_columns,
    page_columns,
    posts_of_messages,
    quarantined,
)
from palaver.sources.posts import write_extracted

_FILE_SCHEMA = "value string"
PAGE = ("thread_id", "page_num")
COPY = (*PAGE, "ingested_at", "source_path")


def ingest_pages(
    spark: SparkSession,
    landing: str,
    out: str,
    thread_pattern: str = FOLDER_PATTERN,
    page_pattern: str = FILE_NAME_DIGITS,
    packed: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """Extract all files that landed since the last call, then return all posts.

    Put each download into a new sub-folder of ``landing``, as one file per page
    or ``packed`` by ``write_pages``: a page fetched again is a new file there,
    while a file rewritten in place, or one of no bytes at all, goes unnoticed. ``out``
    receives the extracted posts, unreadable ones marked, a manifest of the pages, and the stream's own
    progress; each micro-batch is parsed and written in one pass. A micro-batch
    that is repeated after a failure replaces its earlier output. Older copies of
    a page remain stored until ``compact``; ``live_posts`` hides them.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if packed:
        pages = packed_page_columns(reader.schema(PACKED_SCHEMA).parquet(landing))
    else:
        files = reader.schema(_FILE_SCHEMA).text(landing, wholetext=True)
        pages = page_columns(files, thread_pattern, page_pattern)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = posts_of_messages(extract_messages(batch), pages=True)
        write_extracted(rows, f"{out}/extracted/batch_id={batch_id}")

    stream = (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return ingested_posts(spark, out)


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever storage the pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in held or [])


def _number(path: str, level: int) -> int:
    return int(path.split("/")[level].rsplit("=", 1)[-1])


def _snapshot(spark: SparkSession, out: str) -> tuple[int, dict[int, str]]:
    """Number of the newest whole snapshot, and the compaction that holds each rewritten batch."""
    numbers = [_number(p, -2) for p in _found(spark, f"{out}/snapshots/*/_SUCCESS")]
    if not numbers:
        return 0, {}
    rows = spark.read.schema("batch_id long, compaction string").json(f"{out}/snapshots/{max(numbers)}")
    return max(numbers), {r.batch_id: r.compaction for r in rows.collect()}  # a row for each batch


def _folders(spark: SparkSession, out: str, is_page: bool) -> list[str]:
    """The folders that hold the stored rows now. Batches without such rows have none."""
    rewritten = _snapshot(spark, out)[1]
    end = f"is_page={str(is_page).lower()}"
    whole = {_number(p, -2) for p in _found(spark, f"{out}/extracted/batch_id=*/_SUCCESS")}
    first = _found(spark, f"{out}/extracted/batch_id=*/{end}")
    kept = [p for p in first if _number(p, -2) in whole and _number(p, -2) not in rewritten]
    for compaction in sorted(set(rewritten.values())):
        second = _found(spark, f"{out}/compacted/{compaction}/batch_id=*/{end}")
        kept += [p for p in second if rewritten.get(_number(p, -2)) == compaction]
    return kept


def _read(spark: SparkSession, out: str, is_page: bool) -> DataFrame:
    schema = PAGES_SCHEMA if is_page else EXTRACTED_SCHEMA
    folders = _folders(spark, out, is_page)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ingested_pages(spark: SparkSession, out: str) -> DataFrame:
    """The manifest: a row for every stored copy of a page, whether it held posts or not."""
    return _read(spark, out, True)


def ingested_posts(spark: SparkSession, out: str) -> DataFrame:
    """Posts of all batches, every stored copy of a page included."""
    return accepted(_read(spark, out, False))


def ingested_problems(spark: SparkSession, out: str) -> DataFrame:
    """Posts of all batches that could not be read, and pages not read to their end, with the reasons."""
    pages = quarantined(ingested_pages(spark, out)).drop("page_messages")
    return quarantined(_read(spark, out, False)).unionByName(pages, allowMissingColumns=True)


def superseded_pages(pages: DataFrame) -> DataFrame:
    """Copies of pages that a newer copy replaces, whatever the newer one holds."""
    rank = F.struct("ingested_at", "source_path")
    newest = pages.groupBy(F.struct(*PAGE).alias("page")).agg(F.max(rank).alias("newest"))
    copies = pages.select(*COPY).distinct().withColumn("page", F.struct(*PAGE))
    return copies.join(newest, "page").where(rank < F.col("newest")).select(*COPY)


def _without(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows of other copies. Superseded copies are few, so Spark sends them to the rows where their measured size allows."""
    key = dead.select(F.struct(*COPY).alias("copy"))
    return rows.withColumn("copy", F.struct(*COPY)).join(key, "copy", "left_anti").drop("copy")


def live_posts(spark: SparkSession, out: str) -> DataFrame:
    """Posts of the newest copy of every page; a page that is empty or unreadable now has none."""
    return _without(ingested_posts(spark, out), superseded_pages(ingested_pages(spark, out)))


def live_problems(spark: SparkSession, out: str) -> DataFrame:
    """What could not be read in the newest copies."""
    return _without(ingested_problems(spark, out), superseded_pages(ingested_pages(spark, out)))


def compact(spark: SparkSession, out: str) -> int:
    """Rewrite the batches that hold superseded copies without them; how many batches that were.

    The new folders are written first and count for nothing until the snapshot
    that names them is complete; a failure in between leaves the table as it was.
    Old folders stay for readers under way, until ``vacuum``. One compaction at a time:
    a second one fails, as its snapshot exists. Superseded copies stay so, whatever lands meanwhile.
    """
    number, rewritten = _snapshot(spark, out)
    if not _folders(spark, out, True):
        return 0
    pages = ingested_pages(spark, out)
    dead = superseded_pages(pages)
    place = F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)", 1).cast("long").alias("batch_id")
    copies, key = pages.select(F.struct(*COPY).alias("copy"), place), dead.select(F.struct(*COPY).alias("copy"))
    affected = sorted(r.batch_id for r in copies.join(key, "copy", "left_semi").select("batch_id").distinct().collect())
    if not affected:
        return 0
    compaction = uuid.uuid4().hex
    parts = []
    for is_page, schema in ((False, EXTRACTED_SCHEMA), (True, PAGES_SCHEMA)):
        folders = [f for f in _folders(spark, out, is_page) if _number(f, -2) in affected]
        if folders:
            rows = spark.read.schema(schema).parquet(*folders).select("*", place)
            parts.append(_without(rows, dead))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    write_extracted(whole, f"{out}/compacted/{compaction}", ("batch_id", "is_page"))
    rewritten = {**rewritten, **dict.fromkeys(affected, compaction)}
    publish(spark, out, number + 1, rewritten)
    return len(affected)


def publish(spark: SparkSession, out: str, number: int, rewritten: dict[int, str]) -> None:
    """Write a snapshot; it holds as soon as it is complete."""
    rows = spark.createDataFrame(list(rewritten.items()), "batch_id long, compaction string")
    rows.coalesce(1).write.mode("error").json(f"{out}/snapshots/{number}")


def vacuum(spark: SparkSession, out: str) -> int:
    """Delete the folders that no snapshot reads any more; how many. Call it when no reader or compaction is under way."""
    number, rewritten = _snapshot(spark, out)
    old = [p for p in _found(spark, f"{out}/extracted/batch_id=*") if _number(p, -1) in rewritten]
    for p in _found(spark, f"{out}/compacted/*/batch_id=*"):
        if rewritten.get(_number(p, -1)) != p.split("/")[-2]:
            old.append(p)
    old += [p for p in _found(spark, f"{out}/snapshots/*") if _number(p, -1) < number]
    for p in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)
