"""Previous / next row and running aggregates per key for keys of any size.

A plain window sorts all rows of a key in one task.  Here a key is cut into slices of the order
column; rows are compared inside their slice, and one summary row per (key, slice) carries the
values across slice borders.  The full rows are shuffled once, by (key, slice); only the summary
rows, which partial aggregation builds map-side, meet in a window per key.

``slice_of`` must not decrease along the order.  Null is a key like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import epoch


def time_slice(ts: str, seconds: int) -> Column:
    return F.floor(epoch(ts) / seconds)


def attach(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of one side row per key; null keys meet too."""
    renamed = side.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [rows[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys]
    return rows.join(renamed, reduce(lambda a, b: a & b, same), "left").drop(*[f"_of_{k}" for k in keys])


def _neighbour(df, keys, order, slice_of, columns, name, forward):
    rows = df.withColumn("_slice", slice_of)
    value = F.struct(*columns)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    step, edge = (F.lead, F.min) if forward else (F.lag, F.max)
    border = (
        rows.groupBy(*keys, "_slice")
        .agg(edge(F.struct(F.struct(*order).alias("o"), value.alias("v"))).alias("_edge"))
        .select(
            *keys,
            "_slice",
            step("_edge.v").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_across"),
        )
        .where(F.col("_across").isNotNull())
    )
    return (
        attach(rows.withColumn("_inside", step(value).over(inside)), border, [*keys, "_slice"])
        .withColumn(name, F.coalesce("_inside", "_across"))
        .drop("_slice", "_inside", "_across")
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], slice_of: Column, columns: list[str], name: str = "previous"
) -> DataFrame:
    """Adds a struct with ``columns`` of the key's previous row; null on its first row."""
    return _neighbour(df, keys, order, slice_of, columns, name, forward=False)


def with_next(
    df: DataFrame, keys: list[str], order: list[str], slice_of: Column, columns: list[str], name: str = "following"
) -> DataFrame:
    return _neighbour(df, keys, order, slice_of, columns, name, forward=True)


def with_running_max(
    df: DataFrame, keys: list[str], order: list[str], slice_of: Column, value: Column, name: str, earlier: bool = False
) -> DataFrame:
    """Adds the largest ``value`` of the key up to and including the row, or of the rows before it if ``earlier``."""
    rows = df.withColumn("_slice", slice_of).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    border = (
        rows.groupBy(*keys, "_slice")
        .agg(F.max("_value").alias("_top"))
        .select(*keys, "_slice", F.max("_top").over(before).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    return (
        attach(rows.withColumn("_here", F.max("_value").over(inside)), border, [*keys, "_slice"])
        .withColumn(name, F.greatest("_here", "_carried"))
        .drop("_slice", "_value", "_here", "_carried")
    )
