"""Incremental runs: each file once, also after a failure."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from timedtext import schemas
from timedtext.operators.ledger import pending_files
from timedtext.plans.translate import (
    Hook,
    Translation,
    read_ledger,
    translate_files,
    write_ledger,
)
from timedtext.session import shared_dir
from timedtext.sources.files import few_listing_tasks, scan_files

# A run has so many batches at most, unless these would be smaller than the least size.
MOST_BATCHES = 4
LEAST_FILES = 10_000


def stream_files(
    spark: SparkSession, input_dir: str, pattern: str = "*.srt", files_per_batch: int = 10_000
) -> DataFrame:
    """The files of a directory as a stream. A file arrives as one row, so the steps
    after it need no state and no watermark."""
    return (
        spark.readStream.format("binaryFile")
        .schema(schemas.FILES)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(input_dir)
    )


def batch_size(spark: SparkSession, input_dir: str, pattern: str = "*.srt") -> int:
    """How many files a batch takes: a share of those in the directory.

    Every batch reads the memory, the ledger and the claims whole, so with batches of a fixed
    size these reads would grow with the square of the files."""
    n = scan_files(spark, input_dir, pattern).select("path").count()
    return max(LEAST_FILES, -(-n // MOST_BATCHES))


def run_name(spark: SparkSession, path: str) -> str:
    """A name that is made once and stored at a path."""
    try:
        return spark.read.schema("name string").parquet(path).first().name
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.parquet(path)
    return name


def translate_stream(
    spark: SparkSession,
    input_dir: str,
    memory: DataFrame,
    job: Translation,
    ledger_path: str,
    checkpoint: str | None = None,
    pattern: str = "*.srt",
    files_per_batch: int | None = None,
    hook: Hook | None = None,
    learned_path: str | None = None,
) -> StreamingQuery:
    """Translates what is new in a directory and has no success in the ledger, then stops.

    The stream checkpoint remembers finished files. A batch that is run again after a
    failure writes the same output files and replaces its own ledger rows: the run's name is
    kept in the checkpoint, so a new checkpoint is a new run. ``files_per_batch`` is
    ``batch_size`` where it is not given.
    """
    checkpoint = checkpoint or (
        f"{shared_dir(spark)}/stream-{job.src_lang}-{job.tgt_lang}"
    )
    name = run_name(spark, f"{checkpoint.rstrip('/')}/run")

    def run(files: DataFrame, batch: int) -> None:
        ledger = read_ledger(files.sparkSession, ledger_path, without=(name, batch))
        pending = pending_files(files, ledger, job.src_lang, job.tgt_lang)
        updates = translate_files(
            pending, memory, job, [input_dir], hook, learned_path, name, batch
        )
        write_ledger(updates, ledger_path, job, name, batch)

    # the files of every batch are listed once more, each as a path of its own
    few_listing_tasks(spark)
    size = files_per_batch or batch_size(spark, input_dir, pattern)
    return (
        stream_files(spark, input_dir, pattern, size)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
