"""Joins that add or test dimensions.

No side is hinted for broadcast: Spark broadcasts a side only when its size, from file
statistics or measured at run time, is below ``autoBroadcastJoinThreshold``; otherwise AQE splits
hot keys of the shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_dimension(facts: DataFrame, dimension: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Left join of unique dimension rows: facts without a match stay."""
    return facts.join(dimension, facts[fact_key] == dimension[dim_key], "left").drop(dimension[dim_key])


def user_regions(events: DataFrame) -> DataFrame:
    return events.select("user_id", "region").distinct()


def in_user_regions(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(user, tour) candidates whose tour region is one the user was active in."""
    return candidates.join(user_regions(events), ["user_id", "region"], "left_semi")


def with_region_flag(candidates: DataFrame, events: DataFrame) -> DataFrame:
    known = user_regions(events).withColumn("in_user_region", F.lit(True))
    return candidates.join(known, ["user_id", "region"], "left").na.fill(False, ["in_user_region"])


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference points to no parent row; null references are not orphans."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(
        keys, F.col(child_key) == F.col("_parent"), "left_anti"
    )


def stack(*frames: DataFrame) -> DataFrame:
    """Several sources as one frame; columns a source lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
