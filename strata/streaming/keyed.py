"""A table by key, kept up to date by a stream of changes.

Rows lie in buckets of their keys.  A batch rewrites the buckets of its own keys and no others.  Deletes stay as marks,
so an older change that comes later brings nothing back; the change with the largest (ts_ms, offset) of a key counts,
and merging one again changes nothing.  A batch is first written whole beside the table, then its buckets are put in
place, so a batch that was stopped in between is completed from what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.cdc import latest

BUCKETS = 64
BUCKET = "_bucket"
STAGED = "_staged"


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder has a name like ``pattern``."""
    files, where = _filesystem(spark, pattern)
    return bool(files.globStatus(where))


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _filesystem(spark, path)
    files.delete(where, True)


def _schema(changes: DataFrame, key: str, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    return ", ".join([f"`{c}` {kinds[c]}" for c in (key, "op", "ts_ms", "offset", *columns)] + [f"{BUCKET} int"])


def merge_batch(batch: DataFrame, batch_id: int, path: str, key: str, columns: list[str], buckets: int = BUCKETS) -> None:
    """Brings the changes (key, op, ts_ms, offset, columns) of one batch into the table at ``path``."""
    spark = batch.sparkSession
    # A query keeps its id with its checkpoint; one that starts anew counts its batches from zero again.
    query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    staged = f"{path}/{STAGED}/query={query_id}/batch={batch_id}"
    schema = _schema(batch, key, columns)
    if not exists(spark, f"{staged}/_SUCCESS"):
        rows = batch.select(key, "op", "ts_ms", "offset", *columns).withColumn(
            BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        )
        # A batch's last change per key first, so a hot key is one row per task.
        rows = latest(rows, [key])
        if exists(spark, f"{path}/{BUCKET}=*"):
            old = spark.read.schema(schema).parquet(path)
            touched = rows.select(BUCKET).distinct()
            rows = latest(rows.unionByName(old.join(touched, BUCKET, "left_semi")), [key])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(staged)
    spark.read.schema(schema).parquet(staged).repartition(BUCKET).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(BUCKET).parquet(path)
    # What the batch before wrote is of no use any more.
    _delete(spark, f"{path}/{STAGED}/query={query_id}/batch={batch_id - 1}")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that are there; ``schema`` names key and columns."""
    every = f"{schema}, op string, ts_ms bigint, offset bigint, {BUCKET} int"
    return spark.read.schema(every).parquet(path).where("op <> 'd'").drop("op", "ts_ms", "offset", BUCKET)


def start(
    changes: DataFrame, path: str, checkpoint: str, key: str, columns: list[str], buckets: int = BUCKETS, once: bool = False
) -> StreamingQuery:
    """Keeps the table at ``path`` up to date.  One query at a time writes to it, always with
    the same number of buckets."""
    writer = (
        changes.writeStream.queryName("keyed_table").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: merge_batch(batch, number, path, key, columns, buckets))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
