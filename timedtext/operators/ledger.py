"""The ledger: one row per input file and language pair with its latest status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.functions import fixed

KEYS = ["path", "src_lang", "tgt_lang"]


def pending_files(
    files: DataFrame, ledger: DataFrame, src_lang: str, tgt_lang: str
) -> DataFrame:
    """Files without a success for the language pair. Joined on the path only, before
    any content is read."""
    done = ledger.where(
        (F.col("status") == fixed.STATUS_SUCCESS)
        & (F.col("src_lang") == src_lang)
        & (F.col("tgt_lang") == tgt_lang)
    ).select("path")
    return files.join(done, "path", "left_anti")


def ledger_merge(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The latest row per key; an update wins over an equally old row.

    An aggregate, so that rows of one file are reduced before the shuffle."""
    columns = schemas.LEDGER.fieldNames()
    value = [c for c in columns if c not in (*KEYS, "updated_at")]
    both = ledger.select(*columns, F.lit(0).alias("newer")).unionByName(
        updates.select(*columns, F.lit(1).alias("newer"))
    )
    return (
        both.groupBy(*KEYS)
        .agg(F.max(F.struct("updated_at", "newer", *value)).alias("last"))
        .select(*KEYS, *[F.col(f"last.{c}").alias(c) for c in (*value, "updated_at")])
        .select(*columns)
    )


def status_summary(ledger: DataFrame) -> DataFrame:
    """Counts per language pair: success, rate limited, error and all."""

    def count(status: str):
        return F.count_if(F.col("status") == status)

    return ledger.groupBy("src_lang", "tgt_lang").agg(
        count(fixed.STATUS_SUCCESS).alias("success"),
        count(fixed.STATUS_RATE_LIMITED).alias("rate_limited"),
        count(fixed.STATUS_ERROR).alias("error"),
        F.count("*").alias("total"),
    )


def conversion_summary(conversions: DataFrame) -> DataFrame:
    """Converted and attempted per target, and whether anything succeeded."""
    return conversions.groupBy("target").agg(
        F.count_if("success").alias("converted"), F.count("*").alias("attempted")
    )
