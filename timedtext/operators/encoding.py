"""Encoding jobs over tables of files ``(path, content)``."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.functions import fixed
from timedtext.functions.codecs import BOM, decode_bytes, decoded_length, encode_text, known_codec
from timedtext.functions.text import encoded_name, normalize_newlines, parent


ANY_LENGTH = -1
COMPAT = {"min_chars": fixed.MIN_DETECT_CHARS, "bom_first": False}


def detect_encoding(
    files: DataFrame,
    candidates: Sequence[str] | None = None,
    min_chars: int = ANY_LENGTH,
    bom_first: bool = True,
) -> DataFrame:
    """Adds ``encoding``: the first candidate that decodes the whole content and gives
    more than ``min_chars`` characters (by default any number, also none); null if none does.
    ``COMPAT`` has the options of the original rules, which take no text of 100 or less.

    Valid UTF-8 is found in the JVM where it is the first candidate; only other files meet
    the Python codecs, in order until one fits. Codecs with a table are judged by the bytes that
    occur, others get the content in chunks (``decoded_length``). ``bom_first`` names files with a
    byte-order mark ``utf-8-sig``; otherwise the order of the candidates decides.
    """
    names = list(candidates or fixed.ENCODINGS)
    unknown = [name for name in names if not known_codec(name)]
    if unknown:
        raise ValueError(f"unknown encodings: {unknown}")

    @F.pandas_udf("string")
    def first_fit(content: pd.Series) -> pd.Series:
        def fit(data: bytes | None) -> str | None:
            if data is None:
                return None
            for name in names:
                length = decoded_length(data, name)
                if length is not None and length > min_chars:
                    return name
            return None

        return pd.Series([fit(data) for data in content], dtype=object)

    content = F.col("content")
    found = first_fit(content)
    if names[0].lower() == "utf-8":
        text = F.try_validate_utf8(content.cast("string"))
        fits = F.coalesce(F.length(normalize_newlines(text)) > min_chars, F.lit(False))
        found = F.when(fits, names[0]).otherwise(first_fit(F.when(~fits, content)))
    if bom_first:
        text = F.try_validate_utf8(content.cast("string"))
        marked = F.startswith(content, F.lit(BOM)) & text.isNotNull()
        found = F.when(marked, "utf-8-sig").otherwise(found)
    return files.withColumn("encoding", found)


def recommended_encodings(languages: DataFrame, language: str = "lang") -> DataFrame:
    """``(lang, rank, encoding)``: the list of the language, else of the language without
    region, else the default. The table has a dozen rows and is a constant map."""
    known = F.create_map(
        *[
            part
            for lang, names in fixed.RECOMMENDED.items()
            for part in (F.lit(lang), F.array(*map(F.lit, names)))
        ]
    )
    default = F.array(*map(F.lit, fixed.RECOMMENDED_DEFAULT))
    lang = F.col(language)
    names = F.coalesce(
        F.try_element_at(known, lang),
        F.try_element_at(known, F.split_part(lang, F.lit("-"), F.lit(1))),
        default,
    )
    return languages.select(
        lang.alias("lang"), F.posexplode(names).alias("pos", "encoding")
    ).select("lang", (F.col("pos") + 1).cast("bigint").alias("rank"), "encoding")


def target_encodings(
    explicit: Sequence[str] | None = None,
    recommended_for: str | None = None,
    everything: bool = False,
) -> list[str]:
    """The targets of a job: all, else recommended, else named ones, else the default."""
    if everything:
        return list(fixed.ENCODINGS)
    if recommended_for is not None:
        base = recommended_for.split("-")[0]
        table = fixed.RECOMMENDED
        return list(table.get(recommended_for, table.get(base, fixed.RECOMMENDED_DEFAULT)))
    return [name.strip() for name in explicit] if explicit else list(fixed.JOB_TARGETS)


def transcode(
    files: DataFrame, target: Column | str, source: Column | str | None = None, **detection
) -> DataFrame:
    """Content in another encoding: adds ``source``, ``target``, replaces ``content`` and
    sets ``success``. Line ends become LF. The source is the given name or column, else
    it is detected (``detection``: options of ``detect_encoding``). Unknown codecs and undecodable files give ``success`` false."""
    read = read_text(files, source, **detection)
    return write_text(read.withColumn("target", named(target))).drop("text")


def named(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def read_text(files: DataFrame, source: Column | str | None, **detection) -> DataFrame:
    if source is None:
        files = detect_encoding(files, **detection).withColumnRenamed("encoding", "source")
    else:
        files = files.withColumn("source", named(source))
    text = normalize_newlines(decode_bytes(F.col("content"), F.col("source")))
    return files.withColumn("text", text).drop("content")


def write_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", encode_text(F.col("text"), F.col("target"))).withColumn(
        "success", F.col("content").isNotNull()
    )


def transcode_fanout(
    files: DataFrame,
    targets: Sequence[str] | Column | None = None,
    output_dir: str | None = None,
    source: Column | str | None = None,
    skip_same: bool = True,
    **detection,
) -> DataFrame:
    """Every file in every target: ``(path, source, target, output_path, content, success,
    skipped)``.

    ``targets`` is a list or an array column. Files are read and decoded once, before the
    rows are multiplied; the rows of ``read_text`` are not read again. With ``skip_same`` a
    target equal to the source is a success without content.
    """
    if targets is None:
        targets = fixed.FANOUT_TARGETS
    wanted = targets if isinstance(targets, Column) else F.array(*map(F.lit, targets))
    read = read_text(files, source, **detection) if "content" in files.columns else files
    read = read.select("path", "source", "text", F.explode(wanted).alias("target"))
    folder = F.lit(output_dir.rstrip("/")) if output_dir else parent("path")
    name = encoded_name("path", F.col("target"))
    same = F.lit(skip_same) & F.coalesce(
        F.lower("source") == F.lower("target"), F.lit(False)
    )
    rows = (
        read.withColumn("output_path", F.concat_ws("/", F.when(folder != "", folder), name))
        .withColumn("skipped", same)
        .withColumn("text", F.when(~same, F.col("text")))
    )
    return write_text(rows).select(
        "path",
        "source",
        "target",
        "output_path",
        "content",
        (F.col("success") | F.col("skipped")).alias("success"),
        "skipped",
    )
