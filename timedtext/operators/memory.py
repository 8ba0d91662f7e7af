"""Translations from a table instead of a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.functions.text import is_blank
from timedtext.operators.runs import compact, read_runs, write_run

MOST_BATCHES = 32
KEYS = ["src_lang", "tgt_lang", "text"]
# Rows are sorted by their first key's first bytes where these differ: languages hardly do.
SORTED_KEYS = ["text", "src_lang", "tgt_lang"]


def build_memory(pairs: DataFrame) -> DataFrame:
    """A translation memory with one row per language pair and text.

    Write it once and hand the written table to the jobs: they rely on unique keys, and
    a plain scan on that side lets Spark split a hot text at run time.
    """
    return (
        pairs.where(~is_blank("text"))
        .groupBy(*SORTED_KEYS)
        .agg(F.min("translated").alias("translated"))
        .select(*KEYS, "translated")
    )


def unique_learned(rows: DataFrame) -> DataFrame:
    """One row for each key, what was learned first."""
    first = F.min(F.struct("learned_at", "translated")).alias("first")
    return rows.groupBy(*KEYS).agg(first).select(*KEYS, "first.translated", "first.learned_at")


def read_learned(spark: SparkSession, path: str) -> DataFrame:
    """The learned memory of all runs, by key; empty where nothing has been learned yet."""
    return unique_learned(read_runs(spark, path, schemas.LEARNED)).drop("learned_at")


def add_learned(rows: DataFrame, path: str, src_lang: str, tgt_lang: str, run: str, batch: int = 0) -> None:
    """Adds what a batch has learned. A batch that is done again reads its earlier rows first, so
    it adds only what they lack; the folders of old batches are compacted."""
    spark, keys = rows.sparkSession, {"src_lang": src_lang, "tgt_lang": tgt_lang}
    rows = rows.select(*KEYS, "translated", F.current_timestamp().alias("learned_at"))
    write_run(rows, path, keys, run, batch, "append")
    compact(spark, path, keys, schemas.LEARNED, unique_learned, MOST_BATCHES, (run, batch))


def joined_memory(memory: DataFrame, learned: DataFrame) -> DataFrame:
    """The memory with learned rows for keys that it lacks."""
    more = learned.join(memory.select(*KEYS), KEYS, "left_anti")
    return memory.unionByName(more, allowMissingColumns=True)


def lookup_translations(
    lines: DataFrame,
    memory: DataFrame,
    text: str = "text",
    on_miss: str = "empty",
    flag: str | None = None,
) -> DataFrame:
    """Adds ``translated`` (and ``words``, where the memory has them) to lines with
    ``src_lang`` and ``tgt_lang``.

    Blank lines give an empty text. A miss gives an empty text (``empty``), the source
    (``source``) or null (``null``). ``flag`` names a further column that is true for misses.

    One equi-join: Spark broadcasts a memory below its size threshold, else both sides
    are shuffled, and a text that fills a large part of all lines is split by the
    skew-join rule. Blank lines, often the most frequent of all, match nothing; their key
    is spread by a hash of the row.
    """
    fallback = {"empty": F.lit(""), "source": F.col(text), "null": F.lit(None)}
    if on_miss not in fallback:
        raise ValueError(f"on_miss must be one of {sorted(fallback)}")
    blank = is_blank(text)
    spread = F.concat(F.lit("\x01"), F.xxhash64(*lines.columns).cast("string"))
    keyed = lines.withColumn("memory_key", F.when(blank, spread).otherwise(F.col(text)))
    words = ["words"] if "words" in memory.columns else []
    known = memory.select(
        F.col("src_lang").alias("memory_src"),
        F.col("tgt_lang").alias("memory_tgt"),
        F.col("text").alias("memory_text"),
        F.col("translated").alias("memory_translated"),
        *words,
    )
    match = (
        (F.col("memory_key") == F.col("memory_text"))
        & (F.col("src_lang") == F.col("memory_src"))
        & (F.col("tgt_lang") == F.col("memory_tgt"))
    )
    found = F.coalesce(F.col("memory_translated"), fallback[on_miss])
    missed = (~blank & F.col("memory_text").isNull()).alias(flag or "missed")
    return keyed.join(known, match, "left").select(
        *lines.columns,
        F.when(blank, "").otherwise(found).alias("translated"),
        *words,
        *([missed] if flag else []),
    )


def memory_misses(lines: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    """The distinct non-blank lines the memory does not have."""
    wanted = (
        lines.select("src_lang", "tgt_lang", F.col(text).alias("text"))
        .where(~is_blank("text"))
        .distinct()
    )
    return wanted.join(memory.select(*KEYS), KEYS, "left_anti")


def extract_translations(responses: DataFrame) -> DataFrame:
    """Translated text out of raw service responses, by ``layout``.

    ``array``: first fields of the entries of the first element, without the last entry;
    ``array_all``: the same with the last entry and without empty ones; ``sentences``:
    the ``trans`` fields; ``cloud``: the first translation of the data object. What does
    not fit gives ``status`` error and no text.
    """
    doc = F.try_parse_json("raw")
    rows = responses.withColumn("doc", doc)
    entries = F.try_variant_get("doc", "$[0]", "array<variant>")
    heads = F.transform(entries, lambda e: F.try_variant_get(e, "$[0]", "string"))
    used = F.slice(heads, F.lit(1), F.greatest(F.size(heads) - 1, F.lit(0)))
    filled = F.filter(heads, lambda h: h != "")
    trans = F.transform(
        F.try_variant_get("doc", "$.sentences", "array<variant>"),
        lambda s: F.try_variant_get(s, "$.trans", "string"),
    )
    first = F.try_variant_get("doc", "$.data.translations[0]", "variant")
    answer = F.coalesce(F.try_variant_get(first, "$.translatedText", "string"), F.lit(""))
    layout = F.col("layout")
    text: Column = (
        F.when(
            (layout == "array") & ~F.exists(used, lambda h: h.isNull()), F.array_join(used, "")
        )
        .when((layout == "array_all") & (F.size(entries) >= 0), F.array_join(filled, ""))
        .when(
            layout == "sentences", F.array_join(F.filter(trans, lambda s: s.isNotNull()), "")
        )
        .when((layout == "cloud") & first.isNotNull(), answer)
    )
    return rows.withColumn("translated", text).select(
        "request_id",
        "layout",
        "translated",
        F.when(F.col("translated").isNull(), "error").otherwise("success").alias("status"),
        F.when(F.col("doc").isNull(), "Not JSON")
        .when(F.col("translated").isNull(), "No translation in the response")
        .alias("message"),
    )
