"""Cues to SRT text, and cue snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.functions.text import format_time, is_blank, legal_content, whole_div
from timedtext.operators.blocks import carried_sums, split_files
from timedtext.operators.sentences import ordered_text

SLICE_MS = 3_600_000
SLICE_CUES = 16384
PART_CUES = 16384


def is_written() -> Column:
    """Which cues are written: not blank, from zero on, and not ending before they start."""
    return ~is_blank("content") & (F.col("start_ms") >= 0) & (F.col("start_ms") <= F.col("end_ms"))


def heavy(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The groups with more than ``most`` rows, marked by ``name``; an aggregate, so a group is
    reduced before it is shuffled."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return counts.select(*keys, F.lit(True).alias(name))


def number_by_time(
    cues: DataFrame, slice_ms: int = SLICE_MS, slice_rows: int = SLICE_CUES
) -> DataFrame:
    """Adds ``number``: 1, 2, .. by start, end and position, without the cues that are
    not written (``is_written``; the jobs count them in their ledger).

    Cues are ranked inside slices of a file; the numbers of the slices before are added from one
    small row per slice. A slice is a range of time. One with more than ``slice_rows`` cues is cut
    by the millisecond of the start, and a millisecond with more than these by end and blocks of
    positions; so however the times of a file cluster, no rank is over more cues than that, but
    for repeats of one position.
    """
    written = cues.where(is_written()).withColumn("slice", whole_div(F.col("start_ms"), slice_ms))
    at, end, place = F.col("start_ms"), F.col("end_ms"), whole_div(F.col("cue"), slice_rows)
    long = heavy(written, ["file_id", "slice"], slice_rows, "long")
    cut = written.join(long, ["file_id", "slice"], "left").withColumn("at", F.when(F.col("long"), at).otherwise(-1))
    full = heavy(cut.where("long"), ["file_id", "at"], slice_rows, "full")
    cut = cut.join(full, ["file_id", "at"], "left")
    cut = cut.withColumn("part", F.struct("slice", "at", F.when(F.col("full"), end), F.when(F.col("full"), place)))
    before = carried_sums(cut.select("file_id", "part"), ["file_id"], {"n": F.lit(1)}, block="part")
    rank = F.row_number().over(
        Window.partitionBy("file_id", "part").orderBy("start_ms", "end_ms", "cue")
    )
    before = before.withColumnRenamed("file_id", "of_file").withColumnRenamed("part", "of_part")
    same = F.col("file_id").eqNullSafe(F.col("of_file")) & F.col("part").eqNullSafe(F.col("of_part"))
    return (
        cut.withColumn("number", rank.cast("bigint"))
        .join(before, same, "left")
        .withColumn("number", F.col("number") + F.coalesce("n_before", F.lit(0)))
        .drop("slice", "long", "at", "full", "part", "of_file", "of_part", "n_before")
    )


def srt_block() -> Column:
    """Text of one numbered cue, closed by a blank line."""
    note = F.coalesce("proprietary", F.lit(""))
    return F.concat(
        F.col("number").cast("string"),
        F.lit("\n"),
        format_time("start_ms"),
        F.lit(" --> "),
        format_time("end_ms"),
        F.when(note != "", F.concat(F.lit(" "), note)).otherwise(""),
        F.lit("\n"),
        legal_content("content"),
        F.lit("\n\n"),
    )


def compose_parts(
    cues: DataFrame, part_cues: int = PART_CUES, slice_ms: int = SLICE_MS
) -> DataFrame:
    """SRT text in parts of a limited number of cues: ``(file_id, part, text)``."""
    short, long = short_and_long(cues, part_cues, slice_ms)
    return parts_of(short, part_cues).unionByName(parts_of(long, part_cues))


def compose_srt(
    cues: DataFrame, part_cues: int = PART_CUES, slice_ms: int = SLICE_MS
) -> DataFrame:
    """SRT text of each file in one row: ``(file_id, text)``; write very large files from
    ``compose_parts``."""
    short, long = short_and_long(cues, part_cues, slice_ms)
    whole = parts_of(long, part_cues).groupBy("file_id").agg(
        ordered_text(F.struct("part", "text"), "").alias("text")
    )
    return parts_of(short, part_cues).select("file_id", "text").unionByName(whole)


def short_and_long(cues: DataFrame, part_cues: int, slice_ms: int) -> tuple[DataFrame, DataFrame]:
    """Numbered cues of files of one part, and of longer ones.

    A short file is ranked as a whole, so that one shuffle does for its numbers and its text;
    ``number_by_time`` shuffles the text for every step."""
    counts = cues.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") > part_cues)
    short, long = split_files(cues, counts)
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms", "end_ms", "cue"))
    return short.where(is_written()).withColumn("number", rank.cast("bigint")), number_by_time(long, slice_ms)


def parts_of(numbered: DataFrame, part_cues: int) -> DataFrame:
    return (
        numbered.select(
            "file_id",
            whole_div(F.col("number") - 1, part_cues).alias("part"),
            F.struct("number", srt_block().alias("text")).alias("block"),
        )
        .groupBy("file_id", "part")
        .agg(ordered_text(F.col("block"), "").alias("text"))
    )


def snapshot_cues(cues: DataFrame, translated: Column | None = None) -> DataFrame:
    """``(file_id, cue, snapshot)`` with the cue as a JSON object; times are numbers."""
    if translated is None:
        translated = F.lit(None).cast("string")
    index = F.col("index") if "index" in cues.columns else F.col("cue")
    body = F.struct(
        index.cast("bigint").alias("index"),
        F.col("start_ms").alias("start_time"),
        F.col("end_ms").alias("end_time"),
        "content",
        "proprietary",
        translated.alias("translated_content"),
    )
    return cues.select("file_id", "cue", F.to_json(body).alias("snapshot"))


def restore_cues(snapshots: DataFrame) -> DataFrame:
    """The cues of a snapshot, with ``translated_content`` (null where there was none)."""
    body = F.from_json("snapshot", schemas.SNAPSHOT).alias("s")
    return snapshots.select("file_id", "cue", body).select(
        "file_id",
        "cue",
        F.col("s.start_time").alias("start_ms"),
        F.col("s.end_time").alias("end_ms"),
        "s.content",
        "s.proprietary",
        "s.index",
        "s.translated_content",
    )
