"""Session settings and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What the jobs rely on; all are plain Spark settings.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of file content are large: limit Arrow batches by size as well
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # sentences are many small groups: aggregate them by hash before falling back to a sort
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.session.timeZone": "UTC",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only a local session, as in
    tests, may go without; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    folder = tempfile.mkdtemp(prefix="timedtext-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_table(table: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    For a table that several later steps read: they prune its columns, and losing an
    executor costs no more than reading it again. ``compression`` is that of the session
    where it is not given.
    """
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path, compression=compression)
    return spark.read.schema(table.schema).parquet(path)
