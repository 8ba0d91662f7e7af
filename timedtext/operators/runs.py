"""Tables that many runs write and every run reads: ledgers, learned memories, claims.

Such a table is a folder with one folder ``run=<name>/batch=<number>`` for what one batch of one
run has written, below the table's own partition folders, if it has some. Nobody writes into
the folder of another run, so runs side by side lose nothing, and a batch that is done again
replaces its own rows or adds to them.

``compact`` puts the merged rows of all finished batches in one snapshot, itself a run, and removes
their folders, so the files that a batch reads do not grow with the batches before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.session import stage_table

PLACE = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]


def run_folder(path: str, keys: dict[str, str], run: str, batch: int = 0) -> str:
    parts = [path.rstrip("/"), *(f"{k}={v}" for k, v in keys.items())]
    return "/".join([*parts, f"run={run}", f"batch={batch}"])


def write_run(
    rows: DataFrame, path: str, keys: dict[str, str], run: str, batch: int = 0, mode: str = "overwrite"
) -> None:
    """Writes the rows of one batch; ``keys`` are the columns that are folders, the same in all
    rows. ``append`` adds to what an earlier attempt of the batch has written."""
    rows.drop(*keys).write.mode(mode).parquet(run_folder(path, keys, run, batch))


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all runs, with ``run`` and ``batch``; none where there is no table yet."""
    placed = T.StructType([*schema.fields, *PLACE])
    try:
        return spark.read.schema(placed).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], placed)


def batches(spark: SparkSession, path: str, keys: dict[str, str]) -> list[tuple[str, int, str]]:
    """Run, number and folder of every batch, from the names of the folders alone."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path("/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in keys.items())]))
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop.Path(top, "run=*/batch=*"))
    out = []
    for status in found or []:
        place = status.getPath()
        run = place.getParent().getName().removeprefix("run=")
        out.append((run, int(place.getName().removeprefix("batch=")), place.toString()))
    return out


def compact(
    spark: SparkSession,
    path: str,
    keys: dict[str, str],
    schema: T.StructType,
    merged: Callable[[DataFrame], DataFrame],
    most: int,
    without: tuple[str, int] | None = None,
) -> bool:
    """Where there are more than ``most`` batches, puts their rows, ``merged``, in one snapshot.
    ``without`` is a batch at work, which is left alone.

    The snapshot is complete before anything is removed, and rows that are in it twice merge to
    one, so a run that dies in between leaves a table with the same meaning.
    """
    old = [b for b in batches(spark, path, keys) if b[:2] != without]
    if len(old) <= most:
        return False
    inside = T.StructType([f for f in schema.fields if f.name not in keys])
    rows = spark.read.schema(inside).parquet(*[folder for *_, folder in old])
    for name, value in keys.items():
        rows = rows.withColumn(name, F.lit(value))
    snapshot = stage_table(merged(rows.select(*schema.fieldNames())), "snapshot")
    write_run(snapshot, path, keys, f"snapshot-{uuid.uuid4().hex}")
    for *_, folder in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(place, True)
        if not list(system.listStatus(place.getParent())):
            system.delete(place.getParent(), False)
    return True
