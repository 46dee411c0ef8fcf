"""Duplicate removal.

Every operator folds copies map-side before the shuffle: either a hash aggregate or a
``row_number() = 1`` window, for which Spark keeps at most one row per key and task
(WindowGroupLimit) before exchanging.  A key with a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import code_list, epoch

# Duplicate keys per source.
DEDUP_KEYS = {
    "app_events": ["event_id"],
    "bookings": ["booking_id"],
    "clickstream": ["session_id", "timestamp", "page_url"],
}


def _ordered(df: DataFrame, first: tuple[str, ...]) -> list[str]:
    return [*first, *[n for n, t in sorted(df.dtypes) if "map<" not in t and "variant" not in t and n not in first]]


def row_order(df: DataFrame, *first: str) -> list[Column]:
    """A total order of rows: those with all of ``first`` present, then by ``first``, then by all other columns that
    can be ordered; nulls come last."""
    present = [F.col(c).isNull().asc() for c in first]
    return present + [F.col(c).asc_nulls_last() for c in _ordered(df, first)]


def order_value(df: DataFrame, *first: str) -> Column:
    """The same order as one comparable value, for ``min_by``."""
    present = [F.col(c).isNull().alias(f"lacks_{c}") for c in first]
    return F.struct(*present, *[x for c in _ordered(df, first) for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key in the given order; rows equal in ``order`` are interchangeable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def by_source(df: DataFrame, source: str, order: list) -> DataFrame:
    return keep_first(df, DEDUP_KEYS[source], order)


def outside_window(df: DataFrame, keys: list[str], ts: str, seconds: int, tie: str) -> DataFrame:
    """Drops a row when the previous row of its key is at most ``seconds`` earlier.

    Rows of one key inside one ``seconds``-wide slice of time are all duplicates of the slice's
    first row, so a plain aggregate per (key, slice) leaves one candidate and the slice's last
    time.  Only those candidates reach the ordered window: at most one row per key and slice,
    however many rows the key has.
    """
    others = [c for c in df.columns if c not in keys]
    candidates = (
        df.withColumn("_slice", F.floor(epoch(ts) / seconds))
        .groupBy(*keys, "_slice")
        .agg(
            F.min_by(F.struct(*others), F.struct(ts, tie)).alias("_row"),
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
        )
    )
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))
    kept = candidates.withColumn("_before", before).where(
        F.col("_before").isNull() | (epoch("_first") - epoch("_before") > seconds)
    )
    return kept.select(*keys, "_row.*").select(*df.columns)


def keep_valid(df: DataFrame, key: str, order: list, rules: dict[str, Column]) -> DataFrame:
    """First row per key with the names of the broken rules; an empty list means accepted."""
    broken = code_list(*[F.when(~ok, name) for name, ok in rules.items()])
    return keep_first(df, [key], order).withColumn("rejected_for", broken)
