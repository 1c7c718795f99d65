"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on for speed, never for correct results.
RECOMMENDED = {
    # Instants as Parquet TIMESTAMP, whose statistics let time filters skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are large; keep the Arrow batches handed to the page parser small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def at_most(spark: SparkSession, key: str, most: int) -> Iterator[None]:
    """Hold a setting at ``most`` or less, where 0 and below mean no limit; bears on jobs that are started inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name on storage every executor reaches.

    That is below the cluster's ``spark.checkpoint.dir``; only a session without
    one (a test on one machine) gets a local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="palaver-")
    return f"{root}/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when a scan has too few splits for it.

    Meant for heavy per-row work on a small table. A scan with at least as many
    splits as cores, any large one, is left as it is: nothing is shuffled.
    ``scan`` must be a plain scan, as counting its splits plans it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
