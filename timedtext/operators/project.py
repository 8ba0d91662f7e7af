"""From translated sentences or lines back to cues."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.functions import fixed
from timedtext.functions.text import (
    MANY_CUTS,
    as_col,
    characters,
    compose_content,
    cut_text,
    let,
    snap_to_space,
    snap_to_word,
    whole_div,
)
from timedtext.operators.align import aligned_ends

MODES = ("compat", "lossless")


def project_translation(
    sentence_rows: DataFrame,
    mode: str = "lossless",
    profile: str = "v1",
    space: Column | bool = False,
    chinese: Column | bool = False,
    words: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Cuts each ``translated`` sentence into the cues that end in it.

    Takes the rows of ``sentence_cues`` with a column ``translated``; gives
    ``(file_id, *keep, cue, sen, piece)``. Cuts are in proportion to the source text and
    moved to the nearest space, or for Chinese to the end of a word where ``words`` (an
    array column) gives the words. In mode ``compat`` a sentence with one cue is cut to
    its source length and a sentence without a cue is dropped; ``lossless`` keeps both
    whole, the latter in the cue that contains it.

    The work is inside the sentence row: the text is never copied to its cues.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    space, chinese = (F.lit(c) if isinstance(c, bool) else c for c in (space, chinese))
    text, n = F.col("translated"), F.col("n")

    rows = (
        sentence_rows.where("kept")
        .withColumn("translated", F.coalesce("translated", F.lit("")))
        .withColumn("ends", aligned_ends())
        .withColumn("n", F.size("ends"))
        .withColumn("whole", F.get("ends", n - 1)["rel"])
        .withColumn("size", F.length(text))
    )
    inner = F.slice("ends", F.lit(1), F.greatest(n - 1, F.lit(0)))
    size = F.col("size")
    rows = rows.withColumn(
        "raw_cuts",
        F.transform(inner, lambda e: whole_div(size * e["rel"], F.col("whole")).cast("int")),
    )
    cuts = F.when(space & ~chinese, snap_to_space(text, F.col("raw_cuts"), profile))
    if words is not None:
        rows = rows.withColumn("words", words)
        has_words = F.col("words").isNotNull() & (F.size("words") > 0) & (size > 0)
        cuts = cuts.when(
            chinese & has_words, snap_to_word(F.col("words"), F.col("raw_cuts"))
        )
    rows = rows.withColumn("cuts", cuts.otherwise(F.col("raw_cuts")))

    def pieces_by(take: Callable[[Column, Column], Column]) -> Column:
        def piece(end: Column, at: Column) -> Column:
            begin = F.when(at == 0, 0).otherwise(F.get("cuts", F.greatest(at - 1, F.lit(0))))
            upto = F.when(at == n - 1, size).otherwise(F.get("cuts", at))
            cut = take(begin, upto)
            if mode == "compat":
                alone = F.substr(text, F.lit(1), end["rel"].cast("int"))
                cut = F.when(n == 1, alone).otherwise(cut)
            return F.struct(end["cue"].alias("cue"), cut.alias("piece"))

        return F.transform("ends", piece)

    # a substring is found by walking to it, so a long row is cut from its characters
    few = pieces_by(lambda a, b: F.substr(text, a + 1, F.greatest(b - a, F.lit(0))))
    many = let(characters(text), lambda chars: pieces_by(lambda a, b: cut_text(chars, a, b)))
    pieces = F.when(n > MANY_CUTS, many).otherwise(few)
    if mode == "lossless":
        inside = F.array(F.struct(F.col("first_cue").alias("cue"), text.alias("piece")))
        pieces = F.when(n == 0, inside).otherwise(pieces)
    return rows.select("file_id", *keep, "sen", F.explode(pieces).alias("part")).select(
        "file_id", *keep, "part.cue", "sen", "part.piece"
    )


def join_pieces(
    pieces: DataFrame,
    tight: Column | bool = False,
    keep: Sequence[str] = (),
    flags: Sequence[str] = (),
) -> DataFrame:
    """``(file_id, cue, translated, *flags)``: the pieces of each cue in the order of
    sentences, with spaces between them, or with nothing where ``tight`` holds. A flag is
    true where it is for any piece.

    Pieces come from the lookup by text, so those of a cue are apart and nothing is won by
    putting them together before the shuffle; the shuffle is the one that a join by cue needs."""
    tight = F.lit(tight) if isinstance(tight, bool) else tight
    ordered = F.sort_array(F.collect_list(F.struct("sen", "piece")))
    texts = F.transform(ordered, lambda p: p["piece"])
    translated = F.when(tight, F.array_join(texts, "")).otherwise(F.array_join(texts, " "))
    return (
        pieces.repartition("file_id", "cue")
        .groupBy("file_id", "cue", *keep)
        .agg(translated.alias("translated"), *(F.bool_or(f).alias(f) for f in flags))
        .select("file_id", "cue", "translated", *flags)
    )


def attach_lines(
    lines: DataFrame, texts: DataFrame, on_mismatch: str = "pad"
) -> DataFrame:
    """Joins the k-th line of a translated text to the k-th line of its file.

    ``lines(file_id, line_no, ..)`` from 1, ``texts(file_id, text)``. Missing lines are
    empty and surplus ones dropped (``pad``), or files with a different number of lines
    are left out (``skip``).
    """
    split = split_lines(texts)
    out = lines.join(split, ["file_id", "line_no"], "left").withColumn(
        "translated", F.coalesce("translated", F.lit(""))
    )
    if on_mismatch == "pad":
        return out
    if on_mismatch != "skip":
        raise ValueError("on_mismatch must be 'pad' or 'skip'")
    good = count_guard(lines, split).where(F.col("status") == fixed.STATUS_SUCCESS)
    return out.join(good.select("file_id"), "file_id", "left_semi")


def split_lines(texts: DataFrame) -> DataFrame:
    return texts.select(
        "file_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "translated")
    ).select("file_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "translated")


def count_guard(cues: DataFrame, lines: DataFrame) -> DataFrame:
    """Per file: as many translated lines as cues, else an error.

    ``(file_id, n_cues, n_lines, status, message)``. Both sides are counted before the
    join, so one row per file meets.
    """
    left = cues.groupBy("file_id").agg(F.count("*").alias("n_cues"))
    right = lines.groupBy("file_id").agg(F.count("*").alias("n_lines"))
    both = left.join(right, "file_id", "full").fillna(0, ["n_cues", "n_lines"])
    same = F.col("n_cues") == F.col("n_lines")
    text = F.concat(
        F.col("n_lines"), F.lit(" lines for "), F.col("n_cues"), F.lit(" cues")
    )
    return both.select(
        "file_id",
        "n_cues",
        "n_lines",
        F.when(same, fixed.STATUS_SUCCESS).otherwise(fixed.STATUS_ERROR).alias("status"),
        F.when(~same, text).alias("message"),
    )


def compose_cues(
    cues: DataFrame, translated: Column | str = "translated", both: bool = True
) -> DataFrame:
    """Replaces the content by the translation, with the original below if ``both``."""
    return cues.withColumn(
        "content", compose_content(as_col(translated), F.col("content"), both)
    )
