"""Batch extracts: landed JSON payloads, files by format, and JDBC tables or queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


UNREADABLE = "_unreadable"


def _json_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(f"data string, {schema}, {UNREADABLE} string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", UNREADABLE)
        .json(path)
    )


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed API responses -> rows.  ``{"data": [...]}`` gives its elements, a list its elements, any other object
    itself.  Pages may have any size.  What cannot be read is not lost: see :func:`unreadable_pages`."""
    pages = _json_pages(spark, path, schema)
    names = pages.drop("data", UNREADABLE).columns
    wrapped = F.from_json("data", f"array<struct<{schema}>>")
    records = F.when(F.col("data").isNotNull(), wrapped).otherwise(F.array(F.struct(*names)))
    return pages.where(F.col(UNREADABLE).isNull()).select(F.explode(records).alias("r")).select("r.*")


def unreadable_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(source, message) of the pages, or elements of them, that are no JSON of the schema; for the dead letters."""
    pages = _json_pages(spark, path, schema).select("*", F.col("_metadata.file_path").alias("source"))
    wrapped = F.from_json("data", f"array<struct<{schema}>>")
    broken = F.col(UNREADABLE).isNotNull() | (F.col("data").isNotNull() & wrapped.isNull())
    return pages.where(broken).select("source", F.coalesce(UNREADABLE, "data").alias("message"))


def files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Object-store files of one format with a stated schema."""
    if fmt == "csv":
        options.setdefault("header", True)
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def jdbc_options(
    url: str,
    driver: str,
    user: str,
    password: str,
    table: str | None = None,
    query: str | None = None,
    watermark_column: str | None = None,
    watermark: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for a whole table or a query, incremental past a mark, and split over
    ``partitions`` ranges of a column so that no single connection reads the whole table."""
    if (table is None) == (query is None):
        raise ValueError("state either a table or a query")
    source = f"({query}) q" if query else table
    if watermark_column and watermark is not None:
        quoted = watermark.replace("'", "''")
        source = f"(SELECT * FROM {source} WHERE {watermark_column} > '{quoted}') w"
    options = {
        "url": url, "driver": driver, "user": user, "password": password,
        "dbtable": source, "fetchsize": str(fetch_size),
    }
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        options |= {
            "partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1],
            "numPartitions": str(partitions),
        }
    return options


def jdbc(spark: SparkSession, **source) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**source)).load()


def extract(spark: SparkSession, source: dict) -> DataFrame:
    """One configured source by its type."""
    kind = source["source_type"]
    if kind == "api":
        return json_records(spark, source["location"], source["schema"])
    if kind in ("s3", "file"):
        return files(spark, source["location"], source["schema"], source.get("format", "parquet"))
    if kind == "jdbc":
        if source.get("watermark") is None and not source.get("partition_column"):
            raise ValueError("a whole table is read over ranges of a partition column, not through one connection")
        return jdbc(
            spark, url=source["jdbc_url"], driver=source["jdbc_driver"], user=source["jdbc_user"],
            password=source["jdbc_password"], table=source.get("source_table") if not source.get("query") else None,
            query=source.get("query"), watermark_column=source.get("watermark_column"), watermark=source.get("watermark"),
            partition_column=source.get("partition_column"), bounds=source.get("bounds"), partitions=source.get("partitions", 1),
        )
    raise ValueError(f"unknown source type: {kind}")
