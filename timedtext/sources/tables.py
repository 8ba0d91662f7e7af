"""Cue tables from ordered tables of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.functions.text import as_col

CUE_STEP_MS = 3000
CUE_SHOWN_MS = 2500


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table that is read by fewer tasks than there are cores, as one file with one row
    group is, is spread over all of them by a unique key. Large tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, key)


def cues_from_turns(
    turns: DataFrame,
    file_id: Column | str = "conv_id",
    turn: Column | str = "turn",
    text: Column | str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One cue per turn; turns are numbered from 0 without gaps."""
    start = as_col(turn).cast("bigint") * CUE_STEP_MS
    return turns.select(
        as_col(file_id).alias("file_id"),
        (as_col(turn).cast("bigint") + 1).alias("cue"),
        start.alias("start_ms"),
        (start + CUE_SHOWN_MS).alias("end_ms"),
        as_col(text).alias("content"),
        F.lit("").alias("proprietary"),
        *keep,
    )


def cues_from_texts(
    texts: DataFrame,
    file_id: Column | str = "doc_id",
    text: Column | str = "text",
    words_per_cue: int = 8,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every text as cues of a few words each, so that sentences span cues.

    Words are what spaces separate; line breaks stay in the content. No shuffle.
    """
    cue = rf"((?:[^ ]* ){{1,{words_per_cue}}})"
    cues = F.regexp_extract_all(F.concat(as_col(text), F.lit(" ")), F.lit(cue), F.lit(1))
    return (
        texts.select(
            as_col(file_id).alias("file_id"), *keep, F.posexplode(cues).alias("pos", "spaced")
        )
        .withColumn("content", F.substr("spaced", F.lit(1), F.length("spaced") - 1))
        .select(
            "file_id",
            (F.col("pos") + 1).cast("bigint").alias("cue"),
            (F.col("pos").cast("bigint") * CUE_STEP_MS).alias("start_ms"),
            (F.col("pos").cast("bigint") * CUE_STEP_MS + CUE_SHOWN_MS).alias("end_ms"),
            "content",
            F.lit("").alias("proprietary"),
            *keep,
        )
    )
