"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six characters.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; that setting is made only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palaver-llm-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and no lineage behind it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(docs: DataFrame) -> DataFrame:
    """All columns inside one, ``doc``: columns that are put beside it clash with no name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def released(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``doc``, some of them with a new value."""
    return [changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; a column used inside a lambda could be computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number all rows from 0 in this order without bringing them to one task.

    The sorted rows are stored; a rank is the place within a partition plus the
    sizes of the partitions before it. Only those sizes meet in one task.
    """
    place = F.monotonically_increasing_id()
    placed = stored(df.sort(*order).withColumn("_place", place), "ranked")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0)")
    starts = sizes.select("_part", before.alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # a row for each partition of the sort
        .withColumn(name, F.col("_before") + row)
        .drop("_part", "_place", "_before")
    )
