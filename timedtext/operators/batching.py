"""Lines packed into requests of a limited number of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions import fixed
from timedtext.functions.text import is_blank
from timedtext.operators.blocks import BLOCK_ROWS, block_of
from timedtext.operators.sentences import ordered_text

SUPER_BLOCKS = 256
# How many rows of an Arrow batch become Python objects at once.
BLOCK_SLICE = 16
REQUEST_SLICE = 256


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_parts(
    lines: DataFrame,
    budget: int = fixed.REQUEST_CHARS,
    strict: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Runs of lines with the same batch: ``(file_id, batch_no, lines)``.

    ``lines(file_id, line_no, line)`` from 1; ``lines`` of the result is
    ``array<struct<line_no, line>>``. A batch is closed by the line that takes it over the
    budget, and that line opens the next one. By default it does not count in its own
    batch (``strict``: it does), so batches can be longer than the budget.

    Where a batch ends depends on all lines before it. Every block of lines is folded in
    its own row; how full the open batch is at the start of a block is worked out
    beforehand for the files that have more than one block (``block_entries``).
    """
    blocks = (
        lines.select("file_id", "line_no", "line")
        .withColumn("block", block_of(F.col("line_no"), block_rows))
        .groupBy("file_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    )
    entries = block_entries(blocks, budget, strict, block_rows)
    ready = blocks.join(entries, ["file_id", "block"], "left").select(
        "file_id",
        "rows",
        F.coalesce("carry", F.lit(0)).cast("bigint").alias("carry"),
        F.coalesce("batches", F.lit(0)).cast("bigint").alias("batches"),
    )

    start = F.struct(
        F.col("carry").alias("total"),
        F.lit(0).alias("at"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc, row):
        size = F.length(row["line"])
        total = acc["total"] + size
        restart = size.cast("bigint") if strict else F.lit(0).cast("bigint")
        over = total > budget
        opens = over & (row["line_no"] > 1)
        return F.struct(
            F.when(over, restart).otherwise(total).alias("total"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"])))
            .otherwise(acc["starts"])
            .alias("starts"),
        )

    folded = ready.withColumn(
        "starts", F.aggregate("rows", start, step, lambda acc: acc["starts"])
    )
    n = F.size("starts")

    def run(k):
        begin = F.when(k == 0, 0).otherwise(F.get("starts", k - 1))
        end = F.when(k == n, F.size("rows")).otherwise(F.get("starts", k))
        return F.struct(
            (F.col("batches") + k).alias("batch_no"),
            F.slice("rows", begin + 1, end - begin).alias("lines"),
        )

    runs = F.transform(F.sequence(F.lit(0), n), run)
    return (
        folded.select("file_id", F.explode(runs).alias("run"))
        .select("file_id", "run.batch_no", "run.lines")
        .where(F.size("lines") > 0)
    )


def batch_lines(
    lines: DataFrame,
    budget: int = fixed.REQUEST_CHARS,
    strict: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(file_id, line_no, line, batch_no)``, batches from 0."""
    parts = batch_parts(lines, budget, strict, block_rows)
    return parts.select("file_id", "batch_no", F.explode("lines").alias("row")).select(
        "file_id", "row.line_no", "row.line", "batch_no"
    )


def batch_text(
    lines: DataFrame,
    budget: int = fixed.REQUEST_CHARS,
    strict: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per batch: ``(file_id, batch_no, first_line, last_line, text)``."""
    parts = batch_parts(lines, budget, strict, block_rows).select(
        "file_id",
        "batch_no",
        F.get("lines", F.lit(0))["line_no"].alias("first"),
        F.element_at("lines", -1)["line_no"].alias("last"),
        F.array_join(F.transform("lines", lambda r: r["line"]), "\n").alias("text"),
    )
    return parts.groupBy("file_id", "batch_no").agg(
        F.min("first").alias("first_line"),
        F.max("last").alias("last_line"),
        ordered_text(F.struct("first", "text"), "\n").alias("text"),
    )


def progress(batches: DataFrame) -> DataFrame:
    """Lines done after each batch that is sent, and their share of the file in percent.

    A batch of blank lines only is never sent and reports nothing.
    """
    total = F.max("last_line").over(Window.partitionBy("file_id")).alias("total_items")
    rows = batches.select(
        "file_id", "batch_no", F.col("last_line").alias("current_index"), is_blank("text").alias("blank"), total
    )
    share = F.col("current_index") * F.lit(100.0) / F.col("total_items")
    return rows.where(~F.col("blank")).drop("blank").withColumn("progress", share)


# --- files of more than one block -------------------------------------------
#
# For a block, "characters in the open batch before it" -> "characters after it, batches
# opened in it" is a small table with one entry per number of characters up to the
# budget. Tables of neighbours combine by lookup, in any grouping: blocks are combined
# in groups of 256, one pass over these groups finds where each begins, and a second pass
# inside the groups finds where each block begins.


def block_entries(blocks: DataFrame, budget: int, strict: bool, block_rows: int) -> DataFrame:
    """State at the start of blocks: ``(file_id, block, carry, batches)``.

    Only for files of more than one block; all others begin with nothing. ``blocks`` has a
    row per block with its lines, from the same aggregate as the folding, so that Spark reads
    the lines once for both. A first block that is not full has no block after it.
    """
    key = blocks.schema["file_id"].dataType.simpleString()
    full = F.element_at("rows", -1)["line_no"] == block_rows
    sized = blocks.where((F.col("block") > 0) | full).select(
        "file_id",
        "block",
        (F.element_at("rows", 1)["line_no"] == 1).alias("first"),
        F.transform("rows", lambda r: F.length(r["line"])).alias("sizes"),
    )

    # a batch of Arrow may have 10,000 rows of whole blocks: few at a time become Python's
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in in_slices(batches, BLOCK_SLICE):
            found = [
                fill_table(sizes.values.to_numpy(zero_copy_only=False), budget, strict, first.as_py()).tobytes()
                for sizes, first in zip(few["sizes"], few["first"])
            ]
            yield pa.RecordBatch.from_arrays(
                [few["file_id"], few["block"], pa.array(found, pa.binary())], ["file_id", "block", "table"]
            )

    tables = sized.mapInArrow(fill, f"file_id {key}, block bigint, table binary").withColumn(
        "super", F.floor(F.col("block") / SUPER_BLOCKS)
    )

    def unpack(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=np.int64).reshape(2, -1)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = map(unpack, pdf.sort_values("block")["table"])
        whole = reduce(lambda a, b: np.stack([b[0][a[0]], a[1] + b[1][a[0]]]), ordered)
        return pdf.head(1)[["file_id", "super"]].assign(table=[whole.tobytes()])

    supers = tables.groupBy("file_id", "super").applyInPandas(
        combine, f"file_id {key}, super bigint, table binary"
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, carry, opened = None, 0, 0
        for pdf in batches:
            states = []
            for file_id, raw in zip(pdf["file_id"], pdf["table"]):
                if file_id != file:
                    file, carry, opened = file_id, 0, 0
                states.append((carry, opened))
                step = unpack(raw)
                carry, opened = int(step[0][carry]), opened + int(step[1][carry])
            yield pdf[["file_id", "super"]].assign(
                carry=[s[0] for s in states], batches=[s[1] for s in states]
            )

    begins = (
        supers.repartition("file_id")
        .sortWithinPartitions("file_id", "super")
        .mapInPandas(walk, f"file_id {key}, super bigint, carry bigint, batches bigint")
    )

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        carry, opened = int(pdf["carry"].iloc[0]), int(pdf["batches"].iloc[0])
        states = []
        for raw in pdf["table"]:
            states.append((carry, opened))
            step = unpack(raw)
            carry, opened = int(step[0][carry]), opened + int(step[1][carry])
        return pdf[["file_id", "block"]].assign(
            carry=[s[0] for s in states], batches=[s[1] for s in states]
        )

    return (
        tables.join(begins, ["file_id", "super"])
        .groupBy("file_id", "super")
        .applyInPandas(spread, f"file_id {key}, block bigint, carry bigint, batches bigint")
    )


def fill_table(sizes: np.ndarray, budget: int, strict: bool, first: bool) -> np.ndarray:
    """For every fill of the open batch: the fill after the block, and batches opened."""
    ends = np.cumsum(sizes.astype(np.int64))
    n = len(ends)
    counted_from = ends - sizes if strict else ends
    following = np.searchsorted(ends, counted_from + budget, side="right")
    following = np.maximum(following, np.arange(n) + 1)
    fills = np.arange(budget + 2, dtype=np.int64)
    opening = np.searchsorted(ends, budget - fills, side="right")

    at, back = np.unique(opening, return_inverse=True)
    last = np.full(len(at), -1, dtype=np.int64)
    count = np.zeros(len(at), dtype=np.int64)
    live = at < n
    while live.any():
        here = at[live]
        last[live] = here
        # the first line of a file opens no second batch
        count[live] += ~((here == 0) & first)
        at[live] = following[here]
        live = at < n
    last, count = last[back], count[back]
    total = ends[-1]
    after = np.where(last < 0, fills + total, total - counted_from[last])
    return np.stack([np.minimum(after, budget + 1), count])


# --- the user's translator ---------------------------------------------------


def translate_with(
    batches: DataFrame, translate: Callable[[str, str, str], str]
) -> DataFrame:
    """Runs ``translate(text, src_lang, tgt_lang)`` on every batch.

    ``batches`` has ``file_id, batch_no, first_line, last_line, text, src_lang,
    tgt_lang``; gives ``(file_id, line_no, translated, status, message)``, one row per
    line of a batch: missing lines are empty, surplus ones dropped. A batch whose
    call fails has status error; the others go on.
    """
    key = batches.schema["file_id"].dataType.simpleString()

    def answered(text: str, src: str, tgt: str) -> tuple[str | None, str | None]:
        try:
            return (translate(text, src, tgt) if text.strip() else "", None)
        except Exception as error:  # any failure of the user's code
            return (None, f"Translation error: {error}")

    def run(requests: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in in_slices(requests, REQUEST_SLICE):
            asked = zip(*(few[name].to_pylist() for name in ("text", "src_lang", "tgt_lang")))
            done = [answered(*request) for request in asked]
            columns = [few[name] for name in ("file_id", "first_line", "last_line")]
            columns += [pa.array([d[n] for d in done], pa.string()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                columns, ["file_id", "first_line", "last_line", "answer", "message"]
            )

    answers = batches.select(
        "file_id", "first_line", "last_line", "text", "src_lang", "tgt_lang"
    ).mapInArrow(
        run,
        f"file_id {key}, first_line bigint, last_line bigint, answer string, message string",
    )
    given = F.split("answer", "\n", -1)
    wanted = F.sequence("first_line", "last_line")
    return answers.withColumn("given", given).select(
        "file_id",
        F.posexplode(wanted).alias("pos", "line_no"),
        "given",
        "message",
    ).select(
        "file_id",
        "line_no",
        F.when(F.col("message").isNull(), F.coalesce(F.get("given", F.col("pos")), F.lit(""))).alias(
            "translated"
        ),
        F.when(F.col("message").isNull(), fixed.STATUS_SUCCESS)
        .otherwise(fixed.STATUS_ERROR)
        .alias("status"),
        "message",
    )


def translate_misses(
    misses: DataFrame,
    translate: Callable[[str, str, str], str],
    buckets: int = 1024,
    budget: int = fixed.REQUEST_CHARS,
) -> DataFrame:
    """New memory rows for distinct missing lines: ``(src_lang, tgt_lang, text,
    translated)``.

    The lines are spread over ``buckets`` per language pair by their hash and packed like
    the lines of a file. Lines whose batch fails give no row and stay misses.
    """
    bucket = F.concat_ws(
        "|", "src_lang", "tgt_lang", F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("string")
    )
    numbered = number_lines(misses.withColumn("file_id", bucket))
    batches = batch_text(numbered.withColumnRenamed("text", "line"), budget=budget)
    languages = F.split("file_id", r"\|")
    answers = translate_with(
        batches.withColumn("src_lang", languages[0]).withColumn("tgt_lang", languages[1]),
        translate,
    ).where(F.col("status") == fixed.STATUS_SUCCESS)
    return numbered.join(answers, ["file_id", "line_no"]).select(
        "src_lang", "tgt_lang", "text", "translated"
    )


def number_lines(bucketed: DataFrame) -> DataFrame:
    """Numbers distinct lines inside their hash buckets, which are even by nature."""
    order = Window.partitionBy("file_id").orderBy("text")
    return bucketed.withColumn("line_no", F.row_number().over(order).cast("bigint"))
