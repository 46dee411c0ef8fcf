"""Publishing: gold tables to an OLAP store over JDBC or to a catalog, records to topics.

A day is computed and written once, beside the table; then it takes the old day's place in one step.  A writer that
fails before that step leaves the old day readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.functions.envelope import wrap

GOLD_TABLES = [
    "user_360_view",
    "booking_metrics",
    "tourism_analytics",
    "recommendation_features",
    "daily_summary",
]
RESULT = "table string, status string, rows bigint, error string"


def jdbc_writer_options(url: str, driver: str, user: str, password: str, table: str, batch_size: int = 10_000) -> dict[str, str]:
    return {
        "url": url, "driver": driver, "user": user, "password": password, "dbtable": table,
        "batchsize": str(batch_size), "isolationLevel": "NONE",
    }


def stage_rows(df: DataFrame, options: dict[str, str]) -> None:
    """Writes the day to the staging table of the target, which an earlier attempt may have left behind."""
    df.write.format("jdbc").options(**staging(options)).mode("overwrite").save()


def staging(options: dict[str, str]) -> dict[str, str]:
    return options | {"dbtable": f"{options['dbtable']}__staged"}


def swap_day(spark: SparkSession, options: dict[str, str], date: str) -> None:
    """Puts the staged rows in the place of the day's in one transaction of the database."""
    jvm = spark._jvm
    jvm.java.lang.Class.forName(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], options["user"], options["password"])
    table, staged = options["dbtable"], staging(options)["dbtable"]
    try:
        connection.setAutoCommit(False)
        statement = connection.prepareStatement(f"DELETE FROM {table} WHERE processing_date = ?")
        statement.setString(1, date)
        statement.executeUpdate()
        connection.createStatement().executeUpdate(f"INSERT INTO {table} SELECT * FROM {staged}")
        connection.commit()
        connection.createStatement().executeUpdate(f"DROP TABLE {staged}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def catalog_options(table: str, location: str) -> dict[str, str]:
    """Target of a catalog table by ``processing_date`` whose days lie in folders of their own under ``location``."""
    return {"dbtable": table, "location": location, "run": uuid.uuid4().hex}


def stage_folder(df: DataFrame, options: dict[str, str]) -> None:
    """Writes the day to a folder that no partition points to."""
    df.drop("processing_date").write.parquet(_folder(options))


def swap_folder(spark: SparkSession, options: dict[str, str], date: str) -> None:
    """Points the day's partition to the staged folder: one change in the catalog, the old folder stays for its readers."""
    table = options["dbtable"]
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (processing_date = '{date}') LOCATION '{_folder(options)}'")
    spark.sql(f"ALTER TABLE {table} PARTITION (processing_date = '{date}') SET LOCATION '{_folder(options)}'")
    spark.catalog.refreshTable(table)


def _folder(options: dict[str, str]) -> str:
    return f"{options['location']}/{options['dbtable']}/run={options['run']}"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which every JDBC target can hold."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({n: F.to_json(n) for n in nested})


def publish_day(
    spark: SparkSession,
    read: Callable[[str], DataFrame],
    target: Callable[[str], dict[str, str]],
    date: str,
    tables: list[str] = GOLD_TABLES,
    stage: Callable[[DataFrame, dict[str, str]], None] = stage_rows,
    swap: Callable[[SparkSession, dict[str, str], str], None] = swap_day,
) -> DataFrame:
    """Replaces the day's rows of every table, so a rerun does not double them.

    Rows are counted as they are staged.  A day without rows is skipped and leaves the table as it is; a failing table
    does not stop the others.  The result has one row per table.
    """
    results = []
    for name in tables:
        try:
            options = target(name)
            counted = Observation()
            day = flat(read(name).where(F.col("processing_date") == date))
            stage(day.observe(counted, F.count(F.lit(1)).alias("rows")), options)
            rows = counted.get["rows"]
            if rows == 0:
                results.append((name, "skipped", 0, None))
                continue
            swap(spark, options, date)
            results.append((name, "published", rows, None))
        except Exception as error:  # one table's failure must not stop the others
            results.append((name, "failed", None, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(results, RESULT)


def records(df: DataFrame, topic: str, source_id: str, source_name: str, at: Column) -> DataFrame:
    """Rows as enveloped messages for a topic."""
    return wrap(df, source_id, source_name, at).withColumn("topic", F.lit(topic))


def to_kafka(messages: DataFrame, servers: str) -> None:
    """Needs the Kafka connector on the class path."""
    messages.select("topic", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "kafka.acks", "all"
    ).save()


def to_files(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").partitionBy("topic").text(path)
