"""Posts at rest, and results of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.schema import POSTS_SCHEMA, check_posts_columns

FORMATS = ("parquet", "json")
REPORT_FORMATS = ("csv", "json", "parquet", "text")
_TIMESTAMPS = "spark.sql.parquet.outputTimestampType"


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a posts table with its fixed schema; other tables are refused."""
    if fmt not in FORMATS:
        raise ValueError(f"posts are read from {' or '.join(FORMATS)}")
    if fmt == "json":
        _check_json(spark, path)
        return spark.read.schema(POSTS_SCHEMA).json(path)
    posts = check_posts_columns(spark.read.parquet(path))
    found, wanted = dict(posts.dtypes), {f.name: f.dataType.simpleString() for f in POSTS_SCHEMA}
    if found != wanted:
        odd = sorted(c for c in wanted if found[c] != wanted[c])
        raise ValueError(f"not a posts table: other types in {odd}")
    return posts


def _check_json(spark: SparkSession, path: str) -> None:
    """Every row must hold all columns in their order: the whole table is looked at."""
    names = F.array(*[F.lit(n) for n in POSTS_SCHEMA.names])
    other = ~F.json_object_keys("value").eqNullSafe(names)
    if spark.read.text(path).filter(other).head(1):
        raise ValueError("not a posts table: other columns, or in another order")


def write_posts(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", cluster: bool = False
) -> None:
    """Write a posts table.

    ``cluster`` range-partitions by thread and post number, so that later reads
    of a thread or a range of posts skip most row groups, and a thread holding
    much of the data spreads over many files. It samples its input, so cluster a
    stored table rather than a running extraction.
    """
    if fmt not in FORMATS:
        raise ValueError(f"posts are written as {' or '.join(FORMATS)}")
    check_posts_columns(df)
    if cluster:
        keys = ["thread_id", "post_num"]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
        return
    _write_parquet(df, path, mode)


def _write_parquet(df: DataFrame, path: str, mode: str, parts: tuple[str, ...] = ()) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_TIMESTAMPS)
    # Parquet keeps statistics for this type only; time filters need them.
    conf.set(_TIMESTAMPS, "TIMESTAMP_MICROS")
    try:
        df.write.mode(mode).parquet(path, partitionBy=list(parts) or None)
    finally:
        conf.set(_TIMESTAMPS, before)


def write_extracted(df: DataFrame, path: str, parts: tuple[str, ...] = ("is_page",)) -> None:
    """Store posts and pages (see ``posts_of_messages``) in one pass, in folders of their own, replacing what is there."""
    _write_parquet(df.withColumn("is_page", F.col("page_messages").isNotNull()), path, "overwrite", parts)


def concat_parts(*parts: DataFrame) -> DataFrame:
    """Union of partial extractions, sorted by post number."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return sort_posts(whole)


def sort_posts(df: DataFrame) -> DataFrame:
    return df.orderBy("post_num")


def latest_version(
    df: DataFrame,
    keys: tuple[str, ...] = ("thread_id", "page_num"),
    version: tuple[str, ...] = ("ingested_at", "source_path"),
) -> DataFrame:
    """Rows of the newest version of each key; older versions are hidden.

    With the default keys a page fetched again replaces the posts of its earlier
    copy, just as overwriting the page would. Only keys and versions are
    aggregated; the wide rows meet them in one semi join on the keys, and the
    join splits a key that holds very many rows. A version that is NULL is the
    oldest; a key that is NULL is a key like others.
    """
    rank = F.struct(*version) if len(version) > 1 else F.col(version[0])
    # One key that is never NULL itself: both sides are hashed by the same expression.
    key = "_".join((*keys, "key"))
    keyed = df.withColumn(key, F.struct(*keys))
    versions = keyed
    if len(version) > 1:
        # The maximum of a pair needs sorted input. Hashing comes first, so that
        # one row per copy of a page is left to sort, not one per post.
        first = F.max(version[0]).alias(version[0])
        versions = keyed.groupBy(key, *version[1:]).agg(first)
    newest = versions.groupBy(key).agg(F.max(rank).alias("_newest"))
    a, b = keyed.withColumn("_version", rank).alias("a"), newest.alias("b")
    # Not an equality, or it would become a second join key and cost a shuffle.
    same = F.col("b._newest").isNull() | (F.col("a._version") >= F.col("b._newest"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & same, "left_semi").drop("_version", key)


def write_report(report: DataFrame, path: str, fmt: str | None = None) -> None:
    """Write a report; the format follows the ending of ``path`` by default.

    Sorted reports stay sorted across the part files.
    """
    fmt = fmt or {"txt": "text"}.get(path.rsplit(".", 1)[-1], path.rsplit(".", 1)[-1])
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"reports are written as {', '.join(REPORT_FORMATS)}")
    writer = report.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
