"""What the operators of this subpackage share: session settings, stored intermediate tables, global ranks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import shared_dir, tune

# Rows of an Arrow batch: long texts make a batch of the default 10,000 rows too large for a worker.
ARROW_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the package's settings and Arrow batches that fit a worker's memory.

    Python workers on this machine get the folder of the package as a search path, wherever the driver was started;
    a cluster brings the package with ``--py-files`` or as an installed one.
    """
    tune(spark)
    environment = spark.sparkContext.environment
    folder = str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, folder])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared folder that all executors reach."""
    return f"{shared_dir(spark).rstrip('/')}/strata-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage like a checkpoint.  Unlike a checkpoint the result carries no partitioning, so a join over it
    has exchanges of its own, which adaptive execution may split where a key is hot, and Spark knows its size.
    The folder goes with the shared folder of the job.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stored`, and the shuffle files of ``df`` go as soon as it is written: nothing reads them again."""
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return stored(df, name)


@contextmanager
def bucketed(df: DataFrame, by: str, name: str) -> Iterator[DataFrame]:
    """``df`` as a table of the shared folder whose buckets hold whole values of ``by``; dropped on leaving.

    Writing shuffles and sorts nothing: each task adds a file to the bucket of its rows, if they have one value.  Joins
    on ``by`` alone read the table bucket by bucket, so only the other side is shuffled.  What is read after leaving
    must be stored before.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = f"strata_{name}_{uuid.uuid4().hex}"
    # With a file open per bucket, rows need not be sorted by bucket first.
    with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "4"):
        df.write.format("parquet").bucketBy(count, by).option("path", fresh_path(spark, name)).saveAsTable(called)
    try:
        yield spark.table(called)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {called}")


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, and so is sorted and merged whatever its size is taken for.

    Spark takes the size of exploded rows for that of the rows before, and broadcasts what seems small through the driver.
    """
    return side.hint("merge")


def byte_text(column: str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def ranked(df: DataFrame, *order: str | Column, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``: its place, from 0, in the order of ``order`` over the whole table.

    A range partitioning deals the rows out, so no task gets all rows of a key if ``order`` ends in something that
    tells rows apart.  Ranks are the place within the partition plus the rows of the partitions before; the latter
    are one row per partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = stored(placed, name)
    before = (
        placed.groupBy(F.shiftright("_at", 33).alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .selectExpr("_part", "sum(_rows) over (order by _part) - _rows as _before")
    )
    # One row per partition: as many as there are tasks, some kilobytes.
    return (
        placed.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(before), "_part")
        .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_before")
    )
