"""Change-data capture: unwrap, latest change per key, apply to a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata import schemas
from strata.operators.clean import keep_changes


def unwrap(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON change events -> op, time, table and the before / after images."""
    parsed = raw.withColumn("_c", F.from_json(F.col(column).cast("string"), schemas.CHANGE_EVENT))
    p = "_c.payload."
    return parsed.select(
        *[c for c in raw.columns if c != column],
        F.col(p + "op").alias("op"),
        F.col(p + "ts_ms").alias("ts_ms"),
        F.col(p + "source.db").alias("db"),
        F.col(p + "source.table").alias("table"),
        F.col(p + "before").alias("before"),
        F.col(p + "after").alias("after"),
        # a delete has no after image, so the key is read from the image that exists
        F.coalesce(p + "after", p + "before").alias("image"),
    )


def latest(changes: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts_ms", "offset")) -> DataFrame:
    """Last change per key.  Each task ships one row per key at most, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def apply_changes(
    base: DataFrame, changes: DataFrame, key: str, columns: list[str], include_snapshot: bool = False
) -> DataFrame:
    """The keyed table after all changes: inserts and updates replace, deletes remove."""
    last = latest(keep_changes(changes, include_snapshot), [key]).select(
        key, "op", *[F.col(c).alias("_" + c) for c in columns]
    )
    merged = base.join(last, key, "full_outer").where(F.col("op").isNull() | (F.col("op") != "d"))
    value = lambda c: F.when(F.col("op").isNull(), F.col(c)).otherwise(F.col("_" + c)).alias(c)
    return merged.select(key, *[value(c) for c in columns])
