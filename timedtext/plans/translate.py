"""Translation of cue tables and of directories of subtitle files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.functions import fixed
from timedtext.functions.text import (
    glue_lines,
    is_blank,
    is_chinese,
    output_name,
    uses_spaces,
)
from timedtext.operators.batching import translate_misses
from timedtext.operators.blocks import BLOCK_ROWS
from timedtext.operators.claims import claim_outputs
from timedtext.operators.compose import compose_parts, compose_srt, is_written
from timedtext.operators.ledger import ledger_merge, pending_files
from timedtext.operators.memory import (
    add_learned,
    joined_memory,
    lookup_translations,
    memory_misses,
    read_learned,
)
from timedtext.operators.project import compose_cues, join_pieces, project_translation
from timedtext.operators.runs import compact, read_runs, write_run
from timedtext.operators.sentences import sentence_cues
from timedtext.session import stage_table
from timedtext.sources.files import (
    check_mounted,
    decode_files,
    parse_files,
    part_folder,
    relative_folder,
    scan_files,
    write_named_files,
    write_text_parts,
)

LANGUAGES = ("src_lang", "tgt_lang")


def translate_split(
    cues: DataFrame,
    memory: DataFrame,
    both: bool = True,
    mode: str = "lossless",
    profile: str = "v1",
    force_space: bool = False,
    on_miss: str = "empty",
    block_rows: int = BLOCK_ROWS,
    flag: str | None = None,
    dense: bool = False,
) -> DataFrame:
    """Translates by sentences that may span cues, and cuts each back into its cues.

    ``cues`` has ``src_lang`` and ``tgt_lang`` per file. Adds ``translated`` and
    ``status`` (``aligned``, or ``unaligned`` for cues behind the last sentence). If the
    memory has a column ``words``, Chinese cuts fall on the ends of these words. ``flag``
    names a further column, true for cues with a part of a sentence that the memory lacks.
    ``dense`` says that cues are numbered 1, 2, .. in their file (see ``fragments``).

    Shuffles: cues by (file, block), their pieces by (file, sentence), sentences by text
    unless the memory is small, and the result by (file, cue). No key is a whole file.
    """
    rows = sentence_cues(cues, profile, LANGUAGES, block_rows, dense)
    found = lookup_translations(rows, memory, "sentence", on_miss, flag)
    flags = (flag,) if flag else ()
    chinese = is_chinese(
        "tgt_lang",
        fixed.CHINESE_LANGUAGES_V0 if profile == "v0" else fixed.CHINESE_LANGUAGES,
    )
    pieces = project_translation(
        found,
        mode,
        profile,
        uses_spaces("tgt_lang", force_space),
        chinese,
        F.col("words") if "words" in found.columns else None,
        (*LANGUAGES, *flags),
    )
    if mode == "lossless":
        translated = join_pieces(pieces, chinese, LANGUAGES, flags)
    else:
        translated = pieces.select("file_id", "cue", F.col("piece").alias("translated"), *flags)
    return finish(cues.join(translated, ["file_id", "cue"], "left"), both)


def translate_naive(
    cues: DataFrame,
    memory: DataFrame,
    both: bool = True,
    on_miss: str = "empty",
    flag: str | None = None,
) -> DataFrame:
    """Translates every cue by itself, its lines glued together. One join."""
    lines = cues.withColumn("line", glue_lines("content"))
    return finish(lookup_translations(lines, memory, "line", on_miss, flag).drop("line"), both)


def finish(rows: DataFrame, both: bool) -> DataFrame:
    status = F.when(F.col("translated").isNull(), "unaligned").otherwise("aligned")
    return compose_cues(
        rows.withColumn("status", status).withColumn(
            "translated", F.coalesce("translated", F.lit(""))
        ),
        both=both,
    )


def translate_cues(
    cues: DataFrame, memory: DataFrame, mode: str = "split", both: bool = True, **options
) -> DataFrame:
    """``naive`` or, for any other mode, ``split``; ``cut`` chooses compat or lossless."""
    cut = options.pop("cut", "lossless")
    if mode == "naive":
        return translate_naive(
            cues, memory, both, options.get("on_miss", "empty"), options.get("flag")
        )
    return translate_split(cues, memory, both, cut, **options)


@dataclass(frozen=True)
class Translation:
    """What to do with the files of a run.

    ``sink`` is ``parts`` (Spark text output, for any file system) or ``files`` (one file
    each, for a folder that all executors mount). ``on_miss`` is that of
    ``lookup_translations``, or ``error``: a file with a miss is an error and is not written.
    """

    src_lang: str
    tgt_lang: str
    output_dir: str
    mode: str = "split"
    cut: str = "lossless"
    both: bool = True
    force_space: bool = False
    encoding: str = "UTF-8"
    on_miss: str = "empty"
    sink: str = "parts"


Hook = Callable[[str, str, str], str]
MISSES_PER_BUCKET = 10_000


def learn(cues: DataFrame, memory: DataFrame, job: Translation, hook: Hook) -> DataFrame:
    """Memory rows for what the memory lacks, from the user's translator."""
    if job.mode == "naive":
        lines = cues.select(*LANGUAGES, glue_lines("content").alias("text"))
    else:
        rows = sentence_cues(cues, keep=LANGUAGES, dense=True).where("kept")
        lines = rows.select(*LANGUAGES, F.col("sentence").alias("text"))
    misses = stage_table(memory_misses(lines, memory), "misses")
    buckets = misses.count() // MISSES_PER_BUCKET + 1
    return stage_table(translate_misses(misses, hook, buckets), "learned")


def translate_files(
    files: DataFrame,
    memory: DataFrame,
    job: Translation,
    roots: Sequence[str] = (),
    hook: Hook | None = None,
    learned_path: str | None = None,
    run: str | None = None,
    batch: int = 0,
) -> DataFrame:
    """Translates files, writes the results and gives the ledger rows of the run.

    Files are read and parsed once into a staged cue table, which the steps after it
    share. Outputs keep their folder below the ``roots``. What the memory and the memory learned
    by earlier batches lack goes to the ``hook``, if there is one; what it gives is added to
    ``learned_path``, so that no batch, run or repeated batch asks for it again.

    The ledger says what was written: ``success`` for files of which every cue with text is
    translated and written, ``partial`` for files with some, ``error`` for files that
    cannot be read, have no cue or no translation, or whose output is another file's too,
    in this run or by the claim of an earlier one.
    """
    spark, run = files.sparkSession, run or uuid.uuid4().hex
    if job.sink != "parts":
        check_mounted(job.output_dir)
    staged = stage_table(parse_files(decode_files(files, job.encoding)), "cues")
    cues = staged.where("cue IS NOT NULL").select(
        *schemas.CUES.fieldNames(),
        is_blank("content").alias("blank"),
        F.lit(job.src_lang).alias("src_lang"),
        F.lit(job.tgt_lang).alias("tgt_lang"),
    )
    if learned_path:
        memory = joined_memory(memory, read_learned(spark, learned_path))
    if hook:
        learned = learn(cues, memory, job, hook)
        if learned_path:
            add_learned(learned, learned_path, job.src_lang, job.tgt_lang, run, batch)
        memory = memory.unionByName(learned, allowMissingColumns=True)
    strict = job.on_miss == "error"
    options = {"on_miss": "empty" if strict else job.on_miss, "flag": "missed"}
    if job.mode != "naive":
        options |= {"cut": job.cut, "force_space": job.force_space, "dense": True}
    done = stage_table(translate_cues(cues, memory, job.mode, job.both, **options), "translated")
    report = stage_table(reported(staged, done, job, roots, strict), "report")
    report = owned(report, job.output_dir, run, batch)

    writable = report.where(F.col("status").isin(fixed.STATUS_SUCCESS, fixed.STATUS_PARTIAL))
    written = done.join(writable.select("file_id"), "file_id", "left_semi")
    if job.sink == "parts":
        parts = compose_parts(written).join(writable.select("file_id", "name"), "file_id")
        write_text_parts(parts.select("name", "part", "text"), job.output_dir, "name")
    else:
        texts = compose_srt(written).join(writable.select("file_id", "name"), "file_id")
        write_named_files(
            texts.select(F.col("name").alias("path"), F.col("text").alias("content")),
            job.output_dir,
        )
    return report.select(
        F.col("file_id").alias("path"),
        F.lit(job.src_lang).alias("src_lang"),
        F.lit(job.tgt_lang).alias("tgt_lang"),
        "status",
        "message",
        "output",
        "progress",
        F.current_timestamp().alias("updated_at"),
    )


def reported(
    staged: DataFrame, done: DataFrame, job: Translation, roots: Sequence[str], strict: bool
) -> DataFrame:
    """One row per file: ``file_id, name, status, message, output, progress``.

    Counts are aggregated per file before anything is joined.
    """
    files = staged.groupBy("file_id").agg(
        F.max("status").alias("status"), F.max("message").alias("message")
    )
    missed = F.coalesce("missed", F.lit(True)) & ~F.col("blank")
    counts = done.groupBy("file_id").agg(
        F.count_if(~F.col("blank")).alias("n"),
        F.count_if(missed).alias("n_missed"),
        F.count_if(~F.col("blank") & ~is_written()).alias("n_dropped"),
        F.count_if(~F.col("blank") & ~missed & is_written()).alias("n_good"),
        F.count_if(is_written()).alias("n_written"),
    )
    name = output_name("file_id", F.lit(job.src_lang), F.lit(job.tgt_lang), job.both)
    rows = files.join(counts, "file_id", "left").withColumn(
        "name", F.concat(relative_folder(F.col("file_id"), roots), name)
    )
    good = F.col("status") == fixed.STATUS_SUCCESS
    shared = rows.where(good).groupBy("name").agg(F.count("*").alias("n_same"))
    rows = rows.join(shared, "name", "left")
    n, n_missed, n_dropped = (F.coalesce(c, F.lit(0)) for c in ("n", "n_missed", "n_dropped"))
    gaps = F.concat(n_missed, F.lit(" cues without a translation, "), n_dropped, F.lit(" not written"))
    problem = (
        F.when(~good, F.col("message"))
        .when(F.col("n_same") > 1, "Another file has the same output")
        .when(n == 0, "No cue with text")
        .when((n_missed == n) | (F.col("n_written") == 0), gaps)
        .when(F.lit(strict) & (n_missed > 0), gaps)
    )
    partial = (n_missed > 0) | (n_dropped > 0)
    folder = F.lit(job.output_dir.rstrip("/") + "/")
    target = F.concat(folder, part_folder(F.col("name")) if job.sink == "parts" else F.col("name"))
    return rows.withColumn("problem", problem).select(
        "file_id",
        "name",
        F.when(F.col("problem").isNotNull(), fixed.STATUS_ERROR)
        .when(partial, fixed.STATUS_PARTIAL)
        .otherwise(fixed.STATUS_SUCCESS)
        .alias("status"),
        F.coalesce("problem", F.when(partial, gaps)).alias("message"),
        F.when(F.col("problem").isNull(), target).alias("output"),
        F.when(F.col("problem").isNull(), F.round(100.0 * F.col("n_good") / n, 1))
        .otherwise(0.0)
        .alias("progress"),
    )


def owned(report: DataFrame, output_dir: str, run: str, batch: int) -> DataFrame:
    """The report with an error for files whose output belongs to another input."""
    wanted = report.where("output IS NOT NULL").select(
        F.col("name").alias("output"), F.col("file_id").alias("input")
    )
    claims = claim_outputs(wanted, output_dir, run, batch).withColumnRenamed("output", "name")
    rows = report.join(claims, "name", "left")
    lost = F.col("output").isNotNull() & (F.col("owner") != F.col("file_id"))
    return rows.select(
        "file_id",
        "name",
        F.when(lost, fixed.STATUS_ERROR).otherwise(F.col("status")).alias("status"),
        F.when(lost, F.concat(F.lit("The output belongs to "), "owner"))
        .otherwise(F.col("message"))
        .alias("message"),
        F.when(~lost, F.col("output")).alias("output"),
        F.when(lost, 0.0).otherwise(F.col("progress")).alias("progress"),
    )


LEDGER_BATCHES = 32


def write_ledger(rows: DataFrame, path: str, job: Translation, run: str, batch: int = 0) -> None:
    """Replaces the rows of this batch of this run, and no others. More than ``LEDGER_BATCHES``
    older batches of the language pair become one snapshot, so what the next run or batch reads
    does not grow with their number."""
    keys = {"src_lang": job.src_lang, "tgt_lang": job.tgt_lang}
    write_run(rows, path, keys, run, batch)
    spark = rows.sparkSession
    empty = spark.createDataFrame([], schemas.LEDGER)
    compact(
        spark, path, keys, schemas.LEDGER, lambda old: ledger_merge(empty, old), LEDGER_BATCHES, (run, batch)
    )


def read_ledger(
    spark: SparkSession, path: str, without: tuple[str, int] | None = None
) -> DataFrame:
    """The latest row per file and language pair of all runs; empty where there is no ledger
    yet. ``without`` leaves out a batch of a run, one that is being done again."""
    rows = read_runs(spark, path, schemas.LEDGER)
    if without:
        rows = rows.where(~((F.col("run") == without[0]) & (F.col("batch") == without[1])))
    return ledger_merge(spark.createDataFrame([], schemas.LEDGER), rows)


def translate_corpus(
    spark: SparkSession,
    input_dir: str | list[str],
    memory: DataFrame,
    job: Translation,
    ledger_path: str,
    pattern: str = "*.srt",
    resume: bool = True,
    recursive: bool = False,
    hook: Hook | None = None,
    learned_path: str | None = None,
) -> DataFrame:
    """All files of a directory that have no success yet; gives the merged ledger."""
    files = scan_files(spark, input_dir, pattern, recursive)
    if resume:
        ledger = read_ledger(spark, ledger_path)
        files = pending_files(files, ledger, job.src_lang, job.tgt_lang)
    roots = [input_dir] if isinstance(input_dir, str) else input_dir
    run = uuid.uuid4().hex
    updates = translate_files(files, memory, job, roots, hook, learned_path, run)
    write_ledger(updates, ledger_path, job, run)
    return read_ledger(spark, ledger_path)
