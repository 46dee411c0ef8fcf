"""Row-level changes of a table as column expressions.

A catalog with row-level operations runs the same changes as SQL, with versions, time travel and compaction of its
own; these forms are for tables that a job writes anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, where: Column, assignments: dict[str, Column]) -> DataFrame:
    """``UPDATE … SET … WHERE``: rows for which the condition is false or null stay."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.when(where, value).otherwise(F.col(c)).cast(types[c]) for c, value in assignments.items()}
    )


def delete(df: DataFrame, where: Column) -> DataFrame:
    """``DELETE … WHERE``: rows for which the condition is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))
