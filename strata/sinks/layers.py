"""Layer tables: partitioned by day, replaced partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _arranged(df: DataFrame, partition_by: list[str], order_by: list[str]) -> DataFrame:
    # rebalance merges small shuffle partitions and splits large ones at the advisory size, so a
    # day or source with a third of the rows is written by several tasks
    out = df.hint("rebalance", *partition_by)
    return out.sortWithinPartitions(*order_by) if order_by else out


def write_path(df: DataFrame, path: str, partition_by: list[str], order_by: list[str] = []) -> None:
    """Overwrites the partitions present in ``df`` and no others; see :func:`replace_day` for reruns of a day."""
    (
        _arranged(df, partition_by, order_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def append_rows(df: DataFrame, path: str, partition_by: list[str], order_by: list[str] = []) -> None:
    """Adds rows to the partitions of ``df``; a job that runs again adds them again, so reruns use :func:`replace_day`."""
    _arranged(df, partition_by, order_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_day(
    df: DataFrame, path: str, day_column: str, day: str, partition_by: list[str] = [], order_by: list[str] = []
) -> None:
    """Replaces the whole folder of one day, also by nothing: rows, queues or sources that an earlier run of the day
    wrote and this one does not are gone."""
    rows = df.drop(day_column)
    rows = _arranged(rows, partition_by, order_by) if partition_by else rows.hint("rebalance")
    if order_by and not partition_by:
        rows = rows.sortWithinPartitions(*order_by)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*partition_by)
        .parquet(f"{path}/{day_column}={day}")
    )


def write_table(df: DataFrame, name: str, partition_by: list[str], order_by: list[str] = []) -> None:
    """Creates the catalog table on first use; later runs replace the partitions they bring."""
    spark = df.sparkSession
    arranged = _arranged(df, partition_by, order_by)
    if not spark.catalog.tableExists(name):
        arranged.write.partitionBy(*partition_by).format("parquet").saveAsTable(name)
        return
    columns = spark.table(name).columns
    previous = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        arranged.select(*columns).write.mode("overwrite").insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", previous)
