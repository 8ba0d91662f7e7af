"""Which input an output belongs to, over all runs that write into one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.operators.runs import compact, read_runs, write_run
from timedtext.session import stage_table

MOST_BATCHES = 32


def claims_path(output_dir: str) -> str:
    """The table of claims of an output folder, beside it."""
    return output_dir.rstrip("/") + ".claims"


def owners(claims: DataFrame) -> DataFrame:
    """The first claim of each output: ``(output, input, claimed_at)``; of equally old ones that
    of the first input by name."""
    first = F.min(F.struct("claimed_at", "input")).alias("first")
    return claims.groupBy("output").agg(first).select("output", "first.input", "first.claimed_at")


def read_owners(spark: SparkSession, output_dir: str) -> DataFrame:
    return owners(read_runs(spark, claims_path(output_dir), schemas.CLAIMS))


def claim_outputs(wanted: DataFrame, output_dir: str, run: str, batch: int = 0) -> DataFrame:
    """Claims ``(output, input)`` for inputs, and gives ``(output, owner)`` of these outputs.

    An output that nobody owns yet gets a claim of this run; after that, the first claim counts,
    so of two runs at work at once only one goes on with it. A claim outlives its run: the
    same input may write the output again, another one never.
    """
    spark = wanted.sparkSession
    path = claims_path(output_dir)
    free = wanted.join(read_owners(spark, output_dir), "output", "left_anti")
    new = free.select("output", "input", F.current_timestamp().alias("claimed_at"))
    write_run(new, path, {}, run, batch, "append")
    compact(spark, path, {}, schemas.CLAIMS, owners, MOST_BATCHES, (run, batch))
    found = read_owners(spark, output_dir).join(wanted.select("output"), "output", "left_semi")
    return stage_table(found.select("output", F.col("input").alias("owner")), "owners")
