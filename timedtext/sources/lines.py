"""Very large subtitle files, read by many tasks each.

``scan_files`` gives a file as one row, of at most 2 GB. Here a file is read as lines by Spark's text
source, which cuts it in *splits* of bytes, and cues are found again across their borders: a
cue opens at a line with a number whose next line begins with two times. The first line and the
sums that a split needs from its neighbours are one row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timedtext.functions import fixed
from timedtext.functions.text import is_blank
from timedtext.operators.blocks import carried_sums
from timedtext.operators.sentences import ordered_text
from timedtext.session import stage_table
from timedtext.sources.files import TIME, cue_fields, parsed_chunks, scan_files

FILE = ["file_id"]


def file_name(place: Column) -> Column:
    """The path as ``scan_files`` gives it, from the address in a file's metadata."""
    return F.regexp_replace(F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))), r"\Afile:///", "file:/")


def scan_lines(
    spark: SparkSession, paths: str | list[str], pattern: str = "*.srt", recursive: bool = False
) -> DataFrame:
    """``(file_id, split, at, line)`` of all lines of UTF-8 files, staged; ``at`` rises inside a
    split. CR, LF and CRLF end a line."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    lines = reader.text(paths).select(
        file_name(F.col("_metadata.file_path")).alias("file_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    return stage_table(lines, "lines")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(file_id, split, at, line, blank, cue)``: the number of the cue that a line belongs to, 0 for
    lines in front of the first one."""
    blank = is_blank("line")
    splits = lines.groupBy("file_id", "split").agg(
        F.min(F.struct("at", "line")).getField("line").alias("first_line"),
        F.count_if(~blank).alias("ink"),
    )
    by_file = Window.partitionBy("file_id").orderBy("split")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    around = splits.select(
        "file_id",
        "split",
        F.lead("first_line").over(by_file).alias("next_first"),
        F.coalesce(F.sum("ink").over(before), F.lit(0)).alias("ink_before"),
    )
    in_split = Window.partitionBy("file_id", "split").orderBy("at")
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead("line").over(in_split), F.col("next_first"))
    rows = lines.join(around, ["file_id", "split"]).select(
        "file_id",
        "split",
        "at",
        "line",
        blank.alias("blank"),
        following.alias("following"),
        (F.sum((~blank).cast("bigint")).over(so_far) + F.col("ink_before")).alias("ink"),
    )
    # The white space in front of a file's first text is no part of it.
    opening = (F.col("ink") == 1) & ~F.col("blank")
    bare = F.when(opening, F.regexp_replace("line", r"\A\x{FEFF}?\s*", "")).otherwise(F.col("line"))
    opens = bare.rlike(r"\A-?\d+\z") & F.coalesce(F.col("following").rlike(rf"\A{TIME} *--> *{TIME}"), F.lit(False))
    rows = rows.select("file_id", "split", "at", bare.alias("line"), "blank", opens.cast("bigint").alias("opens"))
    carried = carried_sums(rows.select("file_id", "split", "opens"), FILE, {"n": F.col("opens")}, block="split")
    cue = F.sum("opens").over(so_far) + F.coalesce("n_before", F.lit(0))
    return rows.join(carried, ["file_id", "split"], "left").withColumn("cue", cue).drop("opens", "n_before")


def parse_lines(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The rows of ``parse_files`` from the lines of UTF-8 files. ``files`` are rows with a ``path``;
    of these, files without a line get a row too.

    Windows are over the lines of a split, groups over the lines of a cue; nothing is over a file
    but one row per split and per file.
    """
    rows = numbered_lines(lines)
    text = ordered_text(F.struct("split", "at", F.col("line").alias("text")), "\n").alias("text")
    texts = rows.where("cue > 0").groupBy("file_id", "cue").agg(text)
    found = F.get(parsed_chunks(F.col("text")), F.lit(0)).alias("c")
    cues = texts.select("file_id", "cue", found).select("file_id", "cue", *cue_fields(F.col("c")))
    cues = stage_table(cues, "line-cues")
    broken = lines.groupBy("file_id").agg(F.max(~F.is_valid_utf8("line")).alias("broken"))
    front = rows.where("cue = 0 AND NOT blank").select("file_id", F.lit(True).alias("front")).distinct()
    out_of_range = F.max(F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("out_of_range")
    times = cues.groupBy("file_id").agg(out_of_range)
    message = (
        F.when(F.col("broken"), "Failed to decode: the bytes are not UTF-8")
        .when(F.col("front"), "Failed to parse: the text does not start with a cue")
        .when(F.col("out_of_range"), "Failed to parse: a cue time is out of range")
        .alias("message")
    )
    known = broken.join(front, FILE, "left").join(times, FILE, "left").select("file_id", message)
    if files is not None:
        names = files.select(F.col("path").alias("file_id"))
        known = names.join(known, FILE, "left")
    status = F.when(F.col("message").isNull(), fixed.STATUS_SUCCESS).otherwise(fixed.STATUS_ERROR)
    known = known.withColumn("status", status)
    good = known.where(F.col("message").isNull()).join(cues, FILE, "left")
    bad = known.where(F.col("message").isNotNull())
    return good.unionByName(bad, allowMissingColumns=True).select("file_id", *cues.columns[1:], "status", "message")


def parse_large_files(
    spark: SparkSession, paths: str | list[str], pattern: str = "*.srt", recursive: bool = False
) -> DataFrame:
    """What ``parse_files`` gives for UTF-8 files, each read and parsed by as many tasks as it has
    splits (``spark.sql.files.maxPartitionBytes``)."""
    names = scan_files(spark, paths, pattern, recursive).select("path")
    return parse_lines(scan_lines(spark, paths, pattern, recursive), names)
