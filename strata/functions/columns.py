"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent(part: str | Column, whole: str | Column) -> Column:
    """``part / whole * 100``; 0 for an empty whole."""
    part, whole = col(part), col(whole)
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def ratio(part: str | Column, whole: str | Column) -> Column:
    part, whole = col(part), col(whole)
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_of(condition: Column, value: str | Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0))


def day_text(c: str | Column) -> Column:
    """``yyyy-MM-dd``; a plain cast, several times cheaper per row than a format pattern."""
    return F.to_date(col(c)).cast("string")


def ts_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def epoch(c: str | Column) -> Column:
    """Seconds since 1970 as a double; accepts zoned and zone-free timestamps."""
    return F.unix_micros(col(c).cast("timestamp")) / 1_000_000


def blank(c: str | Column) -> Column:
    """Null or empty string, which the quality rules both call missing."""
    c = col(c)
    return c.isNull() | (c.cast("string") == "")


def bucket(c: str | Column, width: float) -> Column:
    """Lower edge of the fixed-width histogram bucket."""
    return F.floor(col(c) / width) * width


def grid(c: str | Column, step: float) -> Column:
    return F.round(col(c) / step) * step


def money(c: str | Column) -> Column:
    """Sum of an amount kept as a double, rounded once to cents; averages divide this total."""
    return F.round(F.sum(col(c)), 2)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns behind a one-row generator.

    The optimizer pushes a filter on a projected column below the projection, with a second copy
    of its expression; for parsing that copy costs as much as the work itself.  Filters stop at a
    generator, so the parsed value is used instead.
    """
    staged = df.withColumns({f"_{name}": c for name, c in columns.items()})
    values = F.struct(*[F.col(f"_{name}").alias(name) for name in columns])
    return staged.select(*df.columns, F.inline(F.array(values)))


def code_list(*codes: Column) -> Column:
    """The non-null codes as an array.  Codes hold no comma.  Built from string functions, which
    stay in generated code; ``array_compact`` would evaluate everything below it interpreted."""
    if not codes:
        return F.array().cast("array<string>")
    return F.array_remove(F.split(F.concat_ws(",", *codes), ","), "")
