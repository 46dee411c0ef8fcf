"""Incremental reads by a high-water mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newer_than(df: DataFrame, watermark_column: str, watermark: str | None) -> DataFrame:
    """Rows past the stored mark.  The mark is a literal of the column's type, so the filter is
    pushed into the scan."""
    if watermark is None:
        return df
    dtype = dict(df.dtypes)[watermark_column]
    return df.where(F.col(watermark_column) > F.lit(watermark).cast(dtype))


def high_water_mark(df: DataFrame, watermark_column: str, *source: Column) -> DataFrame:
    """New mark and number of rows per source, to be stored after the load."""
    return df.groupBy(*source).agg(
        F.count("*").alias("new_rows"), F.max(watermark_column).alias("watermark")
    )
