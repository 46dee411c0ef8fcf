"""Session settings, lineage cutting and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan of this package counts on.  AQE coalesces small shuffle
# partitions and splits hot join keys; the forced form splits them even where the split costs
# one more shuffle, because a third of a large table in one task costs far more.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(
    app: str, master: str | None = None, partitions: int | None = None, task_mb: int | None = None, **conf: str
) -> SparkSession:
    """A session with the package's settings; ``conf`` keys use ``__`` for dots.

    ``partitions`` is the number of shuffle partitions a job starts with; adaptive execution merges them up to
    ``task_mb`` of input per task but splits only join keys, so a large job states as many as its largest shuffle
    needs at that size.
    """
    if partitions:
        conf |= {"spark__sql__shuffle__partitions": str(partitions)}
    if task_mb:
        conf |= {"spark__sql__adaptive__advisoryPartitionSizeInBytes": f"{task_mb}m"}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="strata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
        return named
    raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/strata-{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
