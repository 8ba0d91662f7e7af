"""Subtitle files in and out."""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from timedtext.functions import fixed
from timedtext.functions.codecs import decode_bytes
from timedtext.functions.text import as_col, is_blank, let, normalize_newlines

# --- fixed values -----------------------------------------------------------
# Where a cue begins, and the fields of one cue.
TIME = r"\d+:\d+:\d+[,.:]\d+"
CUE_BREAK = rf"\n+(?=-?\d+\n{TIME} *--> *{TIME})"
CUE_HEAD = (
    r"\A(-?\d+)\n"
    r"(\d+):(\d+):(\d+)[,.:](\d+) *--> *"
    r"(\d+):(\d+):(\d+)[,.:](\d+)[ \t]*"
)
# --- end of fixed values ----------------------------------------------------


def scan_files(
    spark: SparkSession, paths: str | list[str], pattern: str = "*.srt", recursive: bool = False
) -> DataFrame:
    """All files of one or more directories whose names match a glob.

    A column that is not used is not read: ``content`` costs nothing until it is asked for.
    Spark's reader keeps a status of every file in the driver; mounted folders with more than
    ``MOST_LISTED`` files are listed by tasks instead, and no list of them is held anywhere.
    """
    folders = [paths] if isinstance(paths, str) else list(paths)
    if are_mounted(spark, folders) and SIMPLE_GLOB.fullmatch(pattern) and are_crowded(folders, recursive):
        return scan_mounted(spark, folders, pattern, recursive)
    few_listing_tasks(spark)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", recursive).load(paths)


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def few_listing_tasks(spark: SparkSession) -> None:
    """Spark lists many paths with a task for each, up to 10,000; from here on with a few for each
    core. A stream reads the setting whenever it lists the files of a batch, so it stays."""
    most = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING_TASKS, None) or most + 1) > most:
        spark.conf.set(LISTING_TASKS, str(most))


MOST_LISTED = 20_000
# Globs that mean the same to Hadoop and to ``fnmatch``.
SIMPLE_GLOB = re.compile(r"(?:[\w.*?-]|\[[\w-]+\])+")
READ_BYTES = 8 << 20


def local_path(path: str) -> str:
    return re.sub(r"/+", "/", re.sub(r"^file:(//)?(?=/)", "", path))


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether a path is one of the file system of the machine."""
    home = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path.startswith("file:/") or (path.startswith("/") and home.startswith("file:"))


def are_mounted(spark: SparkSession, folders: Sequence[str]) -> bool:
    """Whether the paths are plain folders of that file system."""
    return all(
        is_local(spark, path)
        and not re.search(r"[*?\[\]{}\\]", path)
        and os.path.isdir(local_path(path))
        for path in folders
    )


def is_hidden(name: str) -> bool:
    """The names that Spark's readers leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def entries(folder: str, recursive: bool) -> Iterator[os.DirEntry]:
    """The files of a folder, one by one."""
    folders = [folder]
    while folders:
        with os.scandir(folders.pop()) as found:
            for entry in found:
                if is_hidden(entry.name):
                    continue
                if not entry.is_dir():
                    yield entry
                elif recursive:
                    folders.append(entry.path)


def are_crowded(folders: Sequence[str], recursive: bool) -> bool:
    names = (entry for path in folders for entry in entries(local_path(path), recursive))
    return next(islice(names, MOST_LISTED, None), None) is not None


def scan_mounted(spark: SparkSession, paths: Sequence[str], pattern: str, recursive: bool) -> DataFrame:
    """The rows of Spark's reader. Every task goes through the names and keeps its share of them;
    contents are read where the column is used, a few megabytes at a time."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    folders, fits = [local_path(path).rstrip("/") for path in paths], re.compile(fnmatch.translate(pattern))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chosen(share: int) -> Iterator[tuple[str, int, int]]:
            for entry in (e for folder in folders for e in entries(folder, recursive)):
                if zlib.crc32(os.fsencode(entry.path)) % tasks == share and fits.match(entry.name):
                    about = entry.stat()
                    if about.st_size:  # Spark's reader gives no row for an empty file
                        yield "file:" + entry.path, about.st_mtime_ns // 1_000_000, about.st_size

        for share in (int(n) for pdf in frames for n in pdf["id"]):
            rows = chosen(share)
            while some := list(islice(rows, 1000)):
                yield pd.DataFrame(some, columns=["path", "modified", "length"])

    @F.pandas_udf(BinaryType())
    def read(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, size = [], 0
        for path in (path for series in names for path in series):
            with open(path.removeprefix("file:"), "rb") as file:
                held.append(file.read())
            size += len(held[-1])
            if size > READ_BYTES:
                yield pd.Series(held, dtype=object)
                held, size = [], 0
        if held:
            yield pd.Series(held, dtype=object)

    rows = spark.range(0, tasks, 1, tasks).mapInPandas(listed, "path string, modified bigint, length bigint")
    return rows.select(
        "path", F.timestamp_millis("modified").alias("modificationTime"), "length", read("path").alias("content")
    )


def decode_files(files: DataFrame, encoding: Column | str = "UTF-8") -> DataFrame:
    """Adds ``text`` with LF line ends, ``status`` and ``message``.

    ``encoding`` is a name or a column of names; any codec Python knows will do.
    """
    name = F.lit(encoding) if isinstance(encoding, str) else encoding
    text = decode_bytes(F.col("content"), name)
    failed = F.concat(
        F.lit("Failed to decode: the bytes are not "),
        name,
    )
    decoded = files.withColumn("text", normalize_newlines(text))
    bad = F.col("text").isNull()
    return decoded.drop("content").select(
        "*",
        F.when(bad, fixed.STATUS_ERROR).otherwise(fixed.STATUS_SUCCESS).alias("status"),
        F.when(bad, failed).alias("message"),
    )


def cue_chunks(text: Column) -> Column:
    body = F.regexp_replace(text, r"\A\x{FEFF}?\s*|\n+\z", "")
    return F.when(is_blank(body), F.array().cast("array<string>")).otherwise(
        F.split(body, CUE_BREAK, -1)
    )


# The nine numbers of a cue, each with a mark behind it; the note and the content follow as
# lines, which no pattern needs to walk through.
FIELDS = "".join(f"${n}\x01" for n in range(1, 10))


def parsed_chunks(text: Column) -> Column:
    """Array of the cues of a text; ``good`` is false for what is no cue or has a time that
    does not fit a BIGINT."""

    def of_fields(field: Column) -> Column:
        def time(n: int) -> Column:
            hours, minutes, seconds, millis = (
                F.get(field, F.lit(n + k)).try_cast("bigint") for k in range(4)
            )
            total = F.try_add(F.try_multiply(hours, F.lit(60)), minutes)
            total = F.try_add(F.try_multiply(total, F.lit(60)), seconds)
            return F.try_add(F.try_multiply(total, F.lit(1000)), millis)

        rest = F.get(field, F.lit(9))
        return F.struct(
            time(1).alias("start_ms"),
            time(5).alias("end_ms"),
            F.regexp_replace(rest, r"\A[^\n]*\n?", "").alias("content"),
            F.substring_index(rest, "\n", 1).alias("proprietary"),
            F.get(field, F.lit(0)).try_cast("bigint").alias("index"),
            (F.size(field) == 10).alias("is_cue"),
        )

    def of_chunk(chunk: Column) -> Column:
        marked = F.rtrim(F.regexp_replace(chunk, CUE_HEAD, FIELDS), F.lit("\n"))
        fields = F.split(marked, "\x01", 10)
        return let(F.when(F.rlike(chunk, F.lit(CUE_HEAD)), fields).otherwise(F.array(chunk)), of_fields)

    return F.transform(cue_chunks(text), of_chunk)


def parse_problem(parsed: Column) -> Column:
    """Why the cues of a file cannot be used, or null."""
    bad_time = F.exists(parsed, lambda c: c["start_ms"].isNull() | c["end_ms"].isNull())
    return F.when(
        (F.size(parsed) > 0) & ~F.get(parsed, F.lit(0))["is_cue"],
        "Failed to parse: the text does not start with a cue",
    ).when(bad_time, "Failed to parse: a cue time is out of range")


def with_problem(decoded: DataFrame) -> DataFrame:
    """Adds ``parsed`` and completes ``status`` and ``message``."""
    problem = parse_problem(F.col("parsed"))
    good = F.col("status") == fixed.STATUS_SUCCESS
    return (
        decoded.withColumn("parsed", parsed_chunks(F.col("text")))
        .withColumn("problem", F.when(good, problem))
        .withColumn("message", F.coalesce("problem", "message"))
        .withColumn(
            "status",
            F.when(F.col("problem").isNotNull(), fixed.STATUS_ERROR).otherwise(F.col("status")),
        )
        .drop("problem")
    )


def parse_status(decoded: DataFrame) -> DataFrame:
    """Status per file after parsing: text in front of the first cue, no cue at all in a file
    that is not blank, or a time out of range, is an error."""
    return with_problem(decoded).drop("parsed")


def cue_fields(cue: Column) -> list[Column]:
    names = ("start_ms", "end_ms", "content", "proprietary", "index")
    return [cue[name].alias(name) for name in names]


def parse_cues(
    decoded: DataFrame, file_id: Column | str = "path", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per cue: the columns of ``schemas.CUES`` and ``index``, the number in the
    file. A file that cannot be parsed gives no rows (see ``parse_status``).

    Cues need no blank line between them; ``.`` and ``:`` pass for the decimal comma.
    Row-local: no shuffle. A filter on the parsed text would be pushed below the parsing and do it
    again for each of its terms, so unusable files are emptied inside one expression.
    """
    usable = let(parsed_chunks(F.col("text")), lambda parsed: F.when(parse_problem(parsed).isNull(), parsed))
    rows = decoded.select(
        as_col(file_id).alias("file_id"), *keep, F.posexplode_outer(usable).alias("pos", "c")
    )
    return rows.where("pos IS NOT NULL").select(
        "file_id", (F.col("pos") + 1).cast("bigint").alias("cue"), *cue_fields(F.col("c")), *keep
    )


def parse_files(decoded: DataFrame, file_id: Column | str = "path") -> DataFrame:
    """Cues and statuses in one pass: the rows of ``parse_cues`` with ``status`` and
    ``message``, and one row without a cue for a file that has none or cannot be used."""
    rows = with_problem(decoded).select(
        as_col(file_id).alias("file_id"),
        "status",
        "message",
        F.when(F.col("status") == fixed.STATUS_SUCCESS, F.col("parsed")).alias("parsed"),
    )
    return rows.select(
        "file_id", "status", "message", F.posexplode_outer("parsed").alias("pos", "c")
    ).select(
        "file_id",
        (F.col("pos") + 1).cast("bigint").alias("cue"),
        *cue_fields(F.col("c")),
        "status",
        "message",
    )


# --- sinks ------------------------------------------------------------------


class NamedFiles(DataSource):
    """``df.write.format("named_files")``: one file per row, ``(path, content BINARY)``.

    The directory is the path given to ``save``; it must be one that all executors see
    (a mounted shared folder), and no other file system (use ``write_text_parts`` there).

    Tasks write into a hidden folder of their attempt. When all tasks are done the driver renames
    the files of the attempts that Spark accepted, and of no others, to their names; if the job
    fails it removes the hidden folder, and no file of the job is seen. The renames of one job
    are not one step: a driver that dies among them leaves whole files, some of them old.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> StructType:
        return StructType([StructField("path", StringType()), StructField("content", BinaryType())])

    def writer(self, schema: StructType, overwrite: bool) -> "NamedFilesWriter":
        return NamedFilesWriter(self.options["path"])


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task's attempt. What is in it the driver reads from the folder, so that
    the names of all files are never in one list."""

    folder: str


def staged_files(folder: str) -> Iterator[tuple[str, str]]:
    """Folder below the attempt's folder, and name, of every file that an attempt has written."""
    for place, _, names in os.walk(folder):
        for name in names:
            yield os.path.relpath(place, folder), name


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = re.sub(r"^file:(//)?(?=/)", "", root)
        self.hidden = os.path.join(self.root, f"._named_files-{uuid.uuid4().hex}")

    def attempt(self) -> str:
        from pyspark import TaskContext

        return os.path.join(self.hidden, str(TaskContext.get().taskAttemptId()))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folder = self.attempt()
        for row in iterator:
            target = os.path.join(folder, row.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "xb") as out:  # a path twice in a task is an error
                out.write(row.content)
        return Staged(folder)

    def commit(self, messages: list) -> None:
        for message in messages:
            made = None
            for place, name in staged_files(message.folder) if message else ():
                target = os.path.normpath(os.path.join(self.root, place))
                if target != made:
                    os.makedirs(target, exist_ok=True)
                    made = target
                os.replace(os.path.join(message.folder, place, name), os.path.join(target, name))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class NamedParts(DataSource):
    """``df.write.format("named_parts")``: lines ``(folder, value)`` in text files of a folder each.

    Every task writes one part into each folder that it has lines of; parts are named by the
    number of the task. A folder that is written replaces an old one, when all tasks are done. Like
    ``named_files``, for a mounted folder.
    """

    @classmethod
    def name(cls) -> str:
        return "named_parts"

    def schema(self) -> StructType:
        return StructType([StructField("folder", StringType()), StructField("value", StringType())])

    def writer(self, schema: StructType, overwrite: bool) -> "NamedPartsWriter":
        return NamedPartsWriter(self.options["path"])


class NamedPartsWriter(NamedFilesWriter):
    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        folder = self.attempt()
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4()}.c000.txt"
        for name, rows in groupby(iterator, lambda row: row.folder):
            place = os.path.join(folder, name)
            os.makedirs(place, exist_ok=True)
            with open(os.path.join(place, part), "ab") as out:
                for row in rows:
                    out.write((row.value or "").encode() + b"\n")
        return Staged(folder)

    def commit(self, messages: list) -> None:
        attempts = [message.folder for message in messages if message and os.path.isdir(message.folder)]
        for folder in attempts:
            for name in os.listdir(folder):
                if os.path.lexists(os.path.join(self.root, name)):
                    shutil.rmtree(os.path.join(self.root, name))
        for folder in attempts:
            for name in os.listdir(folder):
                target = os.path.join(self.root, name)
                if not os.path.lexists(target):
                    os.rename(os.path.join(folder, name), target)
                    continue
                for part in os.listdir(os.path.join(folder, name)):
                    os.replace(os.path.join(folder, name, part), os.path.join(target, part))
        os.makedirs(self.root, exist_ok=True)
        with open(os.path.join(self.root, "_SUCCESS"), "wb"):
            pass
        self.abort(messages)


def check_mounted(directory: str) -> None:
    """Refuses a directory that can be no mounted folder, before any work is done."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", directory)
    if scheme and scheme[1].lower() != "file":
        raise ValueError(f"named files need a mounted folder, not {directory!r}")


def register_sink(spark: SparkSession, sink: type[DataSource]) -> None:
    """Makes a sink known for the write that follows.

    Spark looks the name up in the active session, which is another one where a batch of a stream
    has used the session of its caller: ``createDataFrame`` makes that active, as is done here."""
    spark.dataSource.register(sink)
    spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)


def write_named_files(files: DataFrame, directory: str) -> None:
    """Writes ``(path, content)`` rows as files of a shared directory."""
    check_mounted(directory)
    register_sink(files.sparkSession, NamedFiles)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format(
        "named_files"
    ).mode("append").save(directory)


# What Spark writes as %XX in the name of a partition folder; the percent sign first.
ESCAPED = "%\"#'*/:=?\\\x7f{[]^"


def part_folder(name: Column) -> Column:
    """The folder, under the output directory, that ``write_text_parts`` gives a name."""
    for char in ESCAPED:
        name = F.replace(name, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.concat(F.lit("output="), name)


def relative_folder(path: Column, roots: Sequence[str]) -> Column:
    """The folder of a file below the first of the roots that holds it, with a slash at its
    end; empty for files of the root itself and for other files."""
    folder = F.lit("")
    for root in reversed(roots):
        top = re.sub(r"^file:(//)?(?=/)", "", root).rstrip("/") + "/"
        at = F.instr(path, F.lit(top))
        below = F.substr(path, at + F.lit(len(top)))
        folder = F.when(at > 0, F.regexp_replace(below, r"[^/]*\z", "")).otherwise(folder)
    return folder


def write_text_parts(parts: DataFrame, directory: str, name: str = "output") -> None:
    """Writes ``(name, part, text)`` rows as lines of text, for any file system.

    Every output file becomes a directory ``output=<name>`` whose part files, read in
    order of their names, are the text. Nothing is held whole: parts of one file may be
    written by several tasks. Writing a name again replaces its directory and no other.

    Spark's own text sink pays several calls of the file system for each directory, many of
    them in the driver, one after another; a mounted folder is written by ``NamedParts``.
    """
    spark = parts.sparkSession
    ordered = parts.select(
        F.col(name).alias("output"), "part", F.regexp_replace("text", r"\n\z", "").alias("value")
    )
    # the names of part files follow the order of ranges, so that they give the order of parts
    ordered = ordered.repartitionByRange("output", "part").sortWithinPartitions("output", "part")
    if is_local(spark, directory):
        register_sink(spark, NamedParts)
        unnamed = F.coalesce("output", F.lit("")) == ""
        folder = F.when(unnamed, "output=__HIVE_DEFAULT_PARTITION__").otherwise(part_folder(F.col("output")))
        ordered.select(folder.alias("folder"), "value").write.format("named_parts").mode("append").save(directory)
        return
    (
        ordered.select("output", "value")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("output")
        .text(directory)
    )
