"""From cues to running text, sentences and the cues each sentence carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions import fixed
from timedtext.functions.text import (
    as_col,
    flatten_lines,
    is_blank,
    rstrip,
    split_at_boundaries,
    split_sentences,
)
from timedtext.operators.blocks import (
    BLOCK_ROWS,
    block_of,
    carried_sums,
    dense_positions,
    running_sum,
)


def cue_offsets(cues: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``cue_end``: where the cue ends in the running text of its file.

    A null content is empty. A cue without a file or number has no place, and a null end.
    """
    size = F.length(F.coalesce("content", F.lit(""))).cast("bigint") + 1
    placed = is_placed()
    ends = running_sum(cues, F.when(placed, size), "cue_end", "cue", block_rows=block_rows)
    return ends.withColumn("cue_end", F.when(placed, F.col("cue_end")))


def is_placed() -> Column:
    """Which cues have a place in a text: those with a file and a number."""
    return F.col("file_id").isNotNull() & F.col("cue").isNotNull()


def document_text(
    cues: DataFrame, profile: str = "v1", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per file: its cues in order as one text.

    The result is one string per file by definition. It is put together in two steps, so
    that the many small cue rows of a large file are joined in parallel. No other
    operator needs this text: sentences are cut from the cues. A null content is empty; cues
    without a file or number have no place.
    """
    text = F.coalesce("content", F.lit(""))
    blocks = (
        cues.where(is_placed())
        .withColumn("block", block_of(F.col("cue"), block_rows))
        .groupBy("file_id", "block")
        .agg(
            ordered_text(F.struct("cue", flatten_lines(text).alias("text")), " ").alias("text")
        )
    )
    whole = blocks.groupBy("file_id").agg(
        ordered_text(F.struct("block", "text"), " ").alias("text")
    )
    text = F.col("text") if profile == "v0" else rstrip("text")
    return whole.select("file_id", text.alias("plain_text"))


def ordered_text(part: Column, separator: str) -> Column:
    """Aggregate: the ``text`` fields joined in the order of the fields before it."""
    ordered = F.sort_array(F.collect_list(part))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), separator)


def text_sentences(
    texts: DataFrame, file_key: str = "file_id", text: Column | str = "text", profile: str = "v1"
) -> DataFrame:
    """Sentences of a table of whole texts: ``(file, sen, sentence)``, no shuffle."""
    parts = split_sentences(as_col(text), profile)
    return texts.select(file_key, F.posexplode(parts).alias("pos", "sentence")).select(
        file_key, (F.col("pos") + 1).cast("bigint").alias("sen"), "sentence"
    )


def sentence_offsets(
    sentences: DataFrame, file_key: str = "file_id", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``sen_start`` and ``sen_end`` to numbered sentences."""
    size = F.length("sentence").cast("bigint") + 1
    ends = running_sum(sentences, size, "sen_end", "sen", file_key, block_rows)
    return ends.withColumn("sen_start", F.col("sen_end") - size)


def fragments(
    cues: DataFrame,
    profile: str = "v1",
    keep: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    dense: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cuts every cue at the sentence boundaries in it.

    Gives ``(file_id, *keep, block, sen, cue, frag, text, closes, ends_cue, frag_end)``: the text
    of a sentence is its fragments in order; ``closes`` marks the last one of a sentence,
    ``ends_cue`` the last one of a cue, and ``frag_end`` is the position in the running
    text right after the fragment and the boundary that closes it.

    There are two tables: files that do not fill a block, whose rows lie together by (file, block)
    so that their sentences need no further shuffle, and files whose sentences may span blocks.

    Whether a white-space character is a boundary depends on the four characters before
    it. Every cue puts at least one character in the running text, so a block also gets
    the last four cues of the block before it, and nothing else of its neighbours.
    ``keep`` names columns that are constant in a file. A null content is empty; cues without
    a file or number are left out.

    Blocks are cut by the *place* of a cue in its file, 1, 2, .. . With ``dense`` the numbers of
    the cues are these places, as in a parsed file; else, where numbers may have gaps or
    repeats, places are counted first, which shuffles the cues once more.
    """
    look = fixed.BOUNDARY_LOOKBACK
    block_rows = max(block_rows, look)
    # A dense number is the place: one column, so that the sums below read the same shuffle.
    if dense:
        cues = cues.withColumn("place", F.col("cue"))
    else:
        order = ["cue", *(c for c in ("start_ms", "end_ms") if c in cues.columns), "content"]
        cues = dense_positions(cues.where(is_placed()), "place", order, block_rows=block_rows)
    home = block_of(F.col("place"), block_rows)
    seen_by = block_of(F.col("place") + look, block_rows)
    number = () if dense else ("cue",)
    rows = cues.select(
        "file_id",
        *keep,
        *number,
        "place",
        F.concat(flatten_lines(F.coalesce("content", F.lit(""))), F.lit(" ")).alias("piece"),
        F.explode(
            F.when(seen_by == home, F.array(home)).otherwise(F.array(home, seen_by))
        ).alias("block"),
    ).where("file_id IS NOT NULL AND block IS NOT NULL")
    in_block = Window.partitionBy("file_id", "block")
    tail = F.right("piece", F.lit(look))
    before = F.concat(
        *[
            F.coalesce(F.lag(tail, n).over(in_block.orderBy("place")), F.lit(""))
            for n in range(look, 0, -1)
        ]
    )
    # Only the kind of the characters matters here, and no boundary may lie in them.
    context = F.regexp_replace(F.right(before, F.lit(look)), fixed.SPACE, "-")
    whole_block = in_block.orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    cut = rows.select(
        "*", context.alias("context"), F.max("place").over(whole_block).alias("last_place")
    ).where(home == F.col("block"))

    parts = split_at_boundaries(F.concat("context", "piece"), profile)
    cut = cut.select(
        "file_id",
        *keep,
        *number,
        "place",
        "block",
        "last_place",
        F.length("piece").cast("bigint").alias("size"),
        F.length("context").alias("skip"),
        parts.alias("parts"),
    )
    # Only a full block has a block after it that needs its sums. Most files are shorter
    # than a block, and for them nothing is cut a second time here.
    # The three filters use the last place only, so that none goes below the shuffle they share.
    carried = carried_sums(
        cut.where(F.col("last_place") == (F.col("block") + 1) * block_rows),
        ["file_id", *keep],
        {"chars": F.col("size"), "closed": (F.size("parts") - 1).cast("bigint")},
        consecutive=True,
    )
    numbered = [F.col("closed") - F.col("closes").cast("bigint") + 1, F.col("chars")]
    short = cut_pieces(cut.where(F.col("last_place") < block_rows), keep, dense)
    long = cut_pieces(cut.where(F.col("last_place") >= block_rows), keep, dense)
    long = long.join(carried.drop(*keep), ["file_id", "block"], "left")
    before = [F.coalesce(name, F.lit(0)) for name in ("closed_before", "chars_before")]

    def placed(pieces: DataFrame, sen: Column, frag_end: Column) -> DataFrame:
        return pieces.select(
            "file_id",
            *keep,
            "block",
            sen.alias("sen"),
            "cue",
            "frag",
            "text",
            "closes",
            "ends_cue",
            frag_end.alias("frag_end"),
        )

    return placed(short, *numbered), placed(long, *(n + b for n, b in zip(numbered, before)))


def cut_pieces(cut: DataFrame, keep: Sequence[str], dense: bool) -> DataFrame:
    """The fragments of cut cues, with ``chars`` and ``closed`` as counted inside their block."""
    # A boundary at the very end of the cue leaves an empty part, which says nothing.
    ends_closed = (F.size("parts") > 1) & (F.element_at("parts", -1) == "")
    used = F.when(ends_closed, F.size("parts") - 1).otherwise(F.size("parts"))
    pieces = (
        cut.withColumn("n_parts", F.size("parts"))
        .withColumn("used", used)
        .select(
            "file_id",
            *keep,
            "block",
            F.col("place" if dense else "cue").alias("cue"),
            "place",
            "skip",
            "n_parts",
            "used",
            F.posexplode(F.slice("parts", F.lit(1), F.col("used"))).alias("frag", "raw"),
        )
        .select(
            "file_id",
            *keep,
            "block",
            "cue",
            "place",
            "frag",
            F.when(F.col("frag") == 0, F.substr("raw", F.col("skip") + 1))
            .otherwise(F.col("raw"))
            .alias("text"),
            (F.col("frag") < F.col("n_parts") - 1).alias("closes"),
            (F.col("frag") == F.col("used") - 1).alias("ends_cue"),
        )
    )

    closes = F.col("closes").cast("bigint")
    size = F.length("text").cast("bigint") + closes
    in_block = Window.partitionBy("file_id", "block")
    running = in_block.orderBy("place", "frag").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return pieces.select(
        "*", F.sum(size).over(running).alias("chars"), F.sum(closes).over(running).alias("closed")
    )


def sentence_cues(
    cues: DataFrame,
    profile: str = "v1",
    keep: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    dense: bool = False,
) -> DataFrame:
    """One row per sentence with the cues that end in it.

    ``(file_id, *keep, sen, sentence, sen_start, sen_end, first_cue, kept, ends)`` where
    ``ends`` is ``array<struct<cue, rel>>`` in order. The text that follows the last
    boundary of a file loses its trailing white space (v0: its last character); when
    nothing is left it is no sentence (``kept`` is false), but the cues that end in it
    are still there. A sentence and the cues in it fit in one row, for a sentence is one
    string and every cue in it has at least one character of it. ``dense``: as in ``fragments``.
    """
    part = F.struct("frag_end", "cue", "text", "ends_cue")
    gathered = [
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.max("closes").alias("closed"),
        F.max(~is_blank("text")).alias("inked"),
        F.min(F.col("frag_end") - F.length("text") - F.col("closes").cast("bigint")).alias(
            "sen_start"
        ),
    ]
    short, long = fragments(cues, profile, keep, block_rows, dense)
    # with the block in the key the rows of a short file stay where they are
    grouped = short.groupBy("file_id", "block", *keep, "sen").agg(*gathered).drop("block")
    grouped = grouped.unionByName(long.groupBy("file_id", *keep, "sen").agg(*gathered))
    raw = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    if profile == "v0":
        open_text = F.substr(raw, F.lit(1), F.length(raw) - 1)
        kept = F.col("closed") | (F.length(raw) > 0)
    else:
        open_text = rstrip(raw)
        kept = F.col("inked")
    return (
        grouped.withColumn("sentence", F.when(F.col("closed"), raw).otherwise(open_text))
        .withColumn("kept", kept)
        .select(
            "file_id",
            *keep,
            "sen",
            "sentence",
            "sen_start",
            (F.col("sen_start") + F.length("sentence") + 1).alias("sen_end"),
            F.element_at("parts", 1)["cue"].alias("first_cue"),
            "kept",
            F.transform(
                F.filter("parts", lambda p: p["ends_cue"]),
                lambda p: F.struct(
                    p["cue"].alias("cue"), (p["frag_end"] - F.col("sen_start")).alias("rel")
                ),
            ).alias("ends"),
        )
    )


def sentences(
    cues: DataFrame, profile: str = "v1", block_rows: int = BLOCK_ROWS, dense: bool = False
) -> DataFrame:
    """Sentences of every file: ``(file_id, sen, sentence, sen_start, sen_end)``."""
    return (
        sentence_cues(cues, profile, block_rows=block_rows, dense=dense)
        .where("kept")
        .select("file_id", "sen", "sentence", "sen_start", "sen_end")
    )
