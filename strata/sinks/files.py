"""Rows shaped for key/value caches, search bulk files, exports and metric exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_entries(df: DataFrame, metric: str, date: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """``analytics:<metric>:<date>`` -> JSON of the other columns, with its expiry time."""
    body = [c for c in df.columns if c not in (metric, date)]
    return df.select(
        F.concat_ws(":", F.lit("analytics"), metric, date).alias("key"),
        F.to_json(F.struct(*body)).alias("value"),
        (now + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("expires_at"),
    )


def bulk_lines(df: DataFrame, index: str, id_column: str) -> DataFrame:
    """Search-index bulk form: an action line and a document line per row."""
    action = F.to_json(
        F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_column).cast("string").alias("_id")).alias("index"))
    )
    return df.select(F.concat_ws("\n", action, F.to_json(F.struct(*df.columns))).alias("value"))


def write_bulk(df: DataFrame, index: str, id_column: str, path: str) -> None:
    """Every task writes its own bulk file; nothing passes through the driver."""
    bulk_lines(df, index, id_column).write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")


def exposition(samples: DataFrame) -> DataFrame:
    """Metric samples -> text lines with help, type and ``name{label="value"} value``."""
    pairs = F.array_sort(
        F.transform(F.map_entries("labels"), lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"')))
    )
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    line = F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string"))
    return samples.select(
        "name",
        F.concat_ws("\n",
            F.concat_ws(" ", F.lit("# HELP"), "name", "help"),
            F.concat_ws(" ", F.lit("# TYPE"), "name", "type"),
            line,
        ).alias("value"),
    )
