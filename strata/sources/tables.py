"""Catalog and Parquet reads; every read states its schema, so no file is opened to infer one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import schemas


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}.parquet")


def catalog_table(spark: SparkSession, name: str, processing_date: str | None = None) -> DataFrame:
    """A catalog table, pruned to one ``processing_date`` partition when a date is given."""
    df = spark.table(name)
    return df if processing_date is None else df.where(F.col("processing_date") == processing_date)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def written_days(spark: SparkSession, path: str, day_column: str) -> list[str]:
    """The days a layer table has a folder for, also an empty one, in order."""
    if not path_exists(spark, path):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)]
    return sorted(n.removeprefix(f"{day_column}=") for n in names if n.startswith(f"{day_column}="))


def bronze_partition(
    spark: SparkSession, root: str, schema: str, where: Column | str, folders: tuple[str, ...] = ()
) -> DataFrame:
    """Bronze rows of one partition filter; an absent folder gives no rows but the full schema.

    ``folders`` are the leading partition folders (``name=value``) of the wanted part: only that part is listed,
    however many folders were ever written.
    """
    path = "/".join([root.rstrip("/"), *folders])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", root) if folders else reader).parquet(path).where(where)


def try_catalog_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    try:
        return spark.table(name)
    except AnalysisException:
        return spark.createDataFrame([], schema)
