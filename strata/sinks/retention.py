"""Retention carried out: old days of a layer table move to an archive, still older ones go.

What is to be done is written first, one row per day folder, and then carried out folder by folder.  A run that was
stopped leaves its list behind; the next one completes it before it makes a new one.  Moving a folder is one step of
the file system, and each step can be repeated.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession

from strata.streaming.keyed import exists

PLAN = "day string, action string"
LIST = "_retention"


def _days(spark: SparkSession, path: str, column: str) -> list[str]:
    """The days that have a folder: names only, no data is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(s.getPath().getName().partition("=")[2] for s in found)


def actions(days: list[str], as_of: date, archive_after_days: int, retention_days: int, archived: bool) -> list[tuple[str, str]]:
    """(day, action) for the days of a table, or of its archive; days that are no date are left alone."""
    out = []
    for day in days:
        try:
            age = as_of - date.fromisoformat(day)
        except ValueError:
            continue
        if age > timedelta(days=retention_days):
            out.append((day, "drop_archived" if archived else "drop"))
        elif age > timedelta(days=archive_after_days) and not archived:
            out.append((day, "archive"))
    return out


def carry_out(spark: SparkSession, path: str, archive: str, column: str) -> int:
    """Does what the list at ``path`` says and removes it; gives the number of its rows, 0 without a list."""
    listed = f"{path}/{LIST}"
    if not exists(spark, f"{listed}/_SUCCESS"):
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # One row per day folder.
    rows = spark.read.schema(PLAN).json(listed).orderBy("day").collect()
    for day, action in rows:
        source, kept = hadoop.Path(f"{path}/{column}={day}"), hadoop.Path(f"{archive}/{column}={day}")
        if action == "drop_archived":
            files.delete(kept, True)
        elif not files.exists(source):
            continue
        elif action == "drop":
            files.delete(source, True)
        else:
            # An older copy of the day in the archive gives way to the day as it is now.
            files.delete(kept, True)
            files.mkdirs(kept.getParent())
            if not files.rename(source, kept):
                raise OSError(f"{source} could not be moved to {kept}")
    files.delete(hadoop.Path(listed), True)
    return len(rows)


def apply(
    spark: SparkSession, path: str, archive: str, column: str, as_of: date, archive_after_days: int, retention_days: int
) -> int:
    """Archives and drops days of the table at ``path`` by their age; gives the number of days acted on.

    Days older than ``retention_days`` are dropped from table and archive, days older than ``archive_after_days`` move
    to the archive, which lies on the same file system.
    """
    done = carry_out(spark, path, archive, column)
    limits = (as_of, archive_after_days, retention_days)
    plan = actions(_days(spark, path, column), *limits, archived=False)
    plan += [a for a in actions(_days(spark, archive, column), *limits, archived=True) if (a[0], "drop") not in plan]
    if plan:
        spark.createDataFrame(plan, PLAN).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").json(f"{path}/{LIST}")
    return done + carry_out(spark, path, archive, column)
