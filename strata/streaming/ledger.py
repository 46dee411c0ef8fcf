"""A ledger of the offsets that batches have read, and the gaps and repeats in it.

A queue that has dropped records before they were read leaves no error behind if the reader is told to go on.  The
ledger keeps, per batch, the dense ranges of offsets of each topic partition; what lies between them was lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.ordered import with_next, with_previous, with_running_max

RANGES = "topic string, partition int, first bigint, last bigint, batch_id bigint"
KEYS = ["topic", "partition"]
# Offsets that are compared in one task.
SLICE = 1 << 16


def ranges(records: DataFrame, slice_offsets: int = SLICE) -> DataFrame:
    """(topic, partition, first, last): runs of successive offsets; an offset read twice stands in two runs."""
    times = records.groupBy(*KEYS, "offset").agg(F.count(F.lit(1)).alias("times"))
    # The n-th copy of an offset belongs to the n-th layer, so every layer holds an offset once.
    rows = times.select(*KEYS, "offset", F.explode(F.expr("sequence(1, cast(times as int))")).alias("layer"))
    keys, part = [*KEYS, "layer"], F.floor(F.col("offset") / slice_offsets)
    beside = with_next(with_previous(rows, keys, ["offset"], part, ["offset"]), keys, ["offset"], part, ["offset"])
    first = F.coalesce(F.col("previous.offset") < F.col("offset") - 1, F.lit(True))
    last = F.coalesce(F.col("following.offset") > F.col("offset") + 1, F.lit(True))
    ends = beside.select(*keys, "offset", first.alias("first"), last.alias("last")).where("first OR last")
    # A run of one offset is first and last at once; any other ends with the next end.
    runs = with_next(ends, keys, ["offset"], part, ["offset"], "end").where("first")
    return runs.select(
        *KEYS, F.col("offset").alias("first"), F.when(F.col("last"), F.col("offset")).otherwise(F.col("end.offset")).alias("last")
    )


def record(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes the ranges of a batch; a batch that is repeated replaces its own."""
    ranges(batch).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(RANGES).parquet(path)


def faults(ledger: DataFrame, earliest: Column | None = None, slice_offsets: int = SLICE) -> DataFrame:
    """(topic, partition, fault, first, last): ``lost`` offsets that no range holds, ``repeated`` ones that several do.

    Nothing is known of offsets before the first range of a partition, unless ``earliest`` names where it should begin.
    """
    part = F.floor(F.col("first") / slice_offsets)
    rows = with_running_max(ledger, KEYS, ["first", "last"], part, F.col("last"), "reached", earlier=True)
    if earliest is not None:
        rows = rows.withColumn("reached", F.coalesce("reached", earliest - 1))
    lost = rows.where("first > reached + 1").select(
        *KEYS, F.lit("lost").alias("fault"), (F.col("reached") + 1).alias("first"), (F.col("first") - 1).alias("last")
    )
    again = rows.where("first <= reached").select(
        *KEYS, F.lit("repeated").alias("fault"), "first", F.least("last", "reached").alias("last")
    )
    return lost.unionByName(again)
