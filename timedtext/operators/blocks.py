"""Running values over files of any size.

A window over a whole file puts the file in one task. Here the rows of a file are cut
in blocks of consecutive positions, the window runs inside ``(file, block)``, and what
earlier blocks add comes from one small row per block. A block holds at most
``block_rows`` positions, so no task grows with a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.text import whole_div

BLOCK_ROWS = 16384


def block_of(position: Column, block_rows: int = BLOCK_ROWS, first: int = 1) -> Column:
    return whole_div(position - first, block_rows)


def split_files(rows: DataFrame, long: DataFrame, file_key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """The rows of the other files, and of the files in ``long``, which has unique keys.

    ``long`` must name none but files of more than a block, and is broadcast: it has a row for
    each of them, if any. Where it is empty, Spark drops the work on its files at run time.
    """
    marked = F.broadcast(long.select(F.col(file_key).alias("long_file")))
    same = F.col(file_key).eqNullSafe(F.col("long_file"))
    return rows.join(marked, same, "left_anti"), rows.join(marked, same, "left_semi")


def carried_sums(
    rows: DataFrame,
    file_keys: Sequence[str],
    sums: dict[str, Column],
    block: str = "block",
    consecutive: bool = False,
) -> DataFrame:
    """What the earlier blocks of the file add up to, for every block but the first.

    One row per block and file; files of one block give no rows, so for them the join
    with this table costs next to nothing. With ``consecutive`` blocks the rows of the
    last block of a file may be left out: each block speaks for the one after it.
    """
    totals = rows.groupBy(*file_keys, block).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    earlier = (
        Window.partitionBy(*file_keys)
        .orderBy(block)
        .rowsBetween(Window.unboundedPreceding, 0 if consecutive else -1)
    )
    carried = [F.sum(name).over(earlier).alias(f"{name}_before") for name in sums]
    served = (F.col(block) + 1).alias(block) if consecutive else F.col(block)
    return totals.select(*file_keys, served, *carried).where(
        F.col(f"{next(iter(sums))}_before").isNotNull()
    )


def running_sum(
    rows: DataFrame,
    value: Column,
    name: str,
    order: str,
    file_key: str = "file_id",
    block_rows: int = BLOCK_ROWS,
    first: int = 1,
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with the row, by ``order``.

    ``order`` must be unique in its file; gaps do no harm.
    """
    blocked = rows.withColumn("block", block_of(F.col(order), block_rows, first))
    carried = carried_sums(
        blocked.select(file_key, "block", value.alias("value")), [file_key], {"value": F.col("value")}
    )
    inside = (
        Window.partitionBy(file_key, "block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.withColumn(name, F.sum(value).over(inside))
        .join(carried, [file_key, "block"], "left")
        .withColumn(name, F.col(name) + F.coalesce("value_before", F.lit(0)))
        .drop("block", "value_before")
    )


def dense_positions(
    rows: DataFrame,
    name: str,
    order: Sequence[str],
    file_key: str = "file_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``name``: 1, 2, .. inside the file by ``order``, whose first column is a whole number
    that may have gaps and repeats. Rows are ranked inside blocks of that number, and what the
    blocks before hold is added; rows of one number that fill a block are one task's work.
    """
    blocked = rows.withColumn("number_block", block_of(F.col(order[0]), block_rows))
    before = carried_sums(
        blocked.select(file_key, "number_block"), [file_key], {"n": F.lit(1)}, block="number_block"
    )
    rank = F.row_number().over(Window.partitionBy(file_key, "number_block").orderBy(*order))
    return (
        blocked.withColumn(name, rank.cast("bigint"))
        .join(before, [file_key, "number_block"], "left")
        .withColumn(name, F.col(name) + F.coalesce("n_before", F.lit(0)))
        .drop("number_block", "n_before")
    )
