"""Which sentence a cue belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.text import whole_div
from timedtext.operators.blocks import BLOCK_ROWS
from timedtext.operators.sentences import is_placed, sentence_cues

BLOCK_CHARS = 65536


def align_cues(
    cues: DataFrame, profile: str = "v1", block_rows: int = BLOCK_ROWS, dense: bool = False
) -> DataFrame:
    """Each cue with the sentence in which it ends.

    ``(file_id, sen, cue, rel, ord, n_in_sen, status)``; ``rel`` is the end of the cue
    counted from the start of the sentence. A cue after the end of the last sentence is
    ``unaligned`` and has no sentence. A cue without a file or number is ``unplaced``, and a
    null content is empty; with ``dense`` (see ``fragments``) there are no unplaced cues.
    """
    placed = explode_alignment(sentence_cues(cues, profile, block_rows=block_rows, dense=dense))
    if dense:
        return placed
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("rel", "ord", "n_in_sen")]
    rest = cues.where(~is_placed()).select(
        "file_id", F.lit(None).cast("bigint").alias("sen"), "cue", *nothing, F.lit("unplaced").alias("status")
    )
    return placed.union(rest)


def explode_alignment(sentence_rows: DataFrame) -> DataFrame:
    found = aligned_ends()
    rows = sentence_rows.withColumn("n", F.size(found)).select(
        "file_id", "sen", "n", F.posexplode("ends").alias("pos", "end")
    )
    ok = F.col("pos") < F.col("n")
    return rows.select(
        "file_id",
        F.when(ok, F.col("sen")).alias("sen"),
        F.col("end.cue").alias("cue"),
        F.when(ok, F.col("end.rel")).alias("rel"),
        F.when(ok, F.col("pos") + 1).cast("bigint").alias("ord"),
        F.when(ok, F.col("n")).cast("bigint").alias("n_in_sen"),
        F.when(ok, F.lit("aligned")).otherwise(F.lit("unaligned")).alias("status"),
    )


def aligned_ends() -> Column:
    """The cue ends that lie inside the sentence. They come first: ends ascend."""
    size = F.col("sen_end") - F.col("sen_start")
    return F.when(F.col("kept"), F.filter("ends", lambda e: e["rel"] <= size)).otherwise(
        F.array().cast("array<struct<cue: bigint, rel: bigint>>")
    )


def align_offsets(
    cue_ends: DataFrame, sentence_ends: DataFrame, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The same for offset tables from anywhere: an as-of lookup, not a range join.

    ``cue_ends(file_id, cue, cue_end)`` and ``sentence_ends(file_id, sen, sen_start,
    sen_end)`` are put on one axis. Inside a block of positions the next sentence end is
    a window; for the last cues of a block it is the first one of the next block that has
    any, found among one row per block.
    """
    sentence = F.struct("sen", "sen_start")
    axis = cue_ends.select(
        "file_id",
        F.col("cue_end").alias("pos"),
        F.lit(0).alias("kind"),
        "cue",
        F.lit(None).cast("struct<sen: bigint, sen_start: bigint>").alias("hit"),
    ).unionByName(
        sentence_ends.select(
            "file_id",
            F.col("sen_end").alias("pos"),
            F.lit(1).alias("kind"),
            F.lit(None).cast("bigint").alias("cue"),
            F.struct(
                F.col("sen").cast("bigint").alias("sen"),
                F.col("sen_start").cast("bigint").alias("sen_start"),
            ).alias("hit"),
        )
    )
    axis = axis.withColumn("block", whole_div(F.col("pos").cast("bigint"), block_chars))
    later = (
        Window.partitionBy("file_id", "block")
        .orderBy("pos", "kind")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    later_blocks = (
        Window.partitionBy("file_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    )
    next_block = (
        axis.groupBy("file_id", "block")
        .agg(F.min(F.when(F.col("kind") == 1, F.struct("pos", "hit"))).alias("head"))
        .withColumn("carried", F.first("head", ignorenulls=True).over(later_blocks))
        .where("carried IS NOT NULL")
        .select("file_id", "block", F.col("carried.hit").alias("carried"))
    )
    found = (
        axis.withColumn("hit", F.first("hit", ignorenulls=True).over(later))
        .where("kind = 0")
        .join(next_block, ["file_id", "block"], "left")
        .withColumn("hit", F.coalesce("hit", "carried"))
    )
    return found.select(
        "file_id",
        F.col("hit.sen").alias("sen"),
        "cue",
        (F.col("pos") - F.col("hit.sen_start")).alias("rel"),
        F.when(F.col("hit").isNull(), F.lit("unaligned"))
        .otherwise(F.lit("aligned"))
        .alias("status"),
    )


def alignment_audit(
    cues: DataFrame, profile: str = "v1", block_rows: int = BLOCK_ROWS, dense: bool = False
) -> DataFrame:
    """Per file: what a translation of it would lose.

    Sentences in which no cue ends, sentences with exactly one cue (cut to the source
    length in compat mode), cues without a sentence, and both totals.
    """
    return audit_sentences(sentence_cues(cues, profile, block_rows=block_rows, dense=dense))


def audit_sentences(sentence_rows: DataFrame) -> DataFrame:
    n = F.size(aligned_ends()).cast("bigint")
    total = F.size("ends").cast("bigint")
    return sentence_rows.groupBy("file_id").agg(
        F.count_if("kept").alias("sentences"),
        F.sum(total).alias("cues"),
        F.count_if(F.col("kept") & (n == 0)).alias("sentences_without_cue"),
        F.count_if(F.col("kept") & (n == 1)).alias("single_cue_sentences"),
        F.sum(total - n).alias("unaligned_cues"),
    )
