"""Benchmark decontamination: one automaton of test windows, one scan of every text.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters. An item of ten or
more words gives all its windows of ten words, a shorter one itself. All windows are one
Aho-Corasick automaton over word numbers, so an occurrence is found at its last word, whatever
stands between the words; places are mapped back to characters of the original text.

Windows are collected to the driver in blocks of at most ``BLOCK_WINDOWS``, which bounds what is
broadcast; a test set of more windows is scanned in several passes over the same rows, in one
stage and without a shuffle.

Defined results: a null text, of a document or an item, has no words. Equal items under one id
are one item; a null ``item_id`` counts as the empty id. Every document row gets its own result,
whether or not its ``doc_id`` is null or repeated. Further columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timedtext.llm.common import MARKS, free_name, lower_ascii, table

WINDOW = 10
BLOCK_WINDOWS = 200_000
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows, each with the sorted ids of its items."""
    words = F.array_remove(F.split(lower_ascii(F.col("text")), MARKS), "")
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")
    ).filter(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1))))
    return (
        items.select("item", "words", starts.alias("start"))
        .select("item", F.array_join(F.slice("words", F.col("start"), F.lit(WINDOW)), " ").alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class Numbers(dict):
    """Word numbers; words that no window has are number 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def build(rows: list[tuple[str, list[str]]]) -> tuple[Numbers, ahocorasick.Automaton]:
    numbers = Numbers()
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, items in rows:
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.encode().split(b" "))
        found.add_word(key, (len(key), tuple(items)))
    found.make_automaton()
    return numbers, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans of words, ends excluded."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPANS = pa.list_(pa.int32())
ITEMS = pa.list_(pa.string())


def scan_block(rows, text: str, spans: str, items: str) -> Callable:
    """Adds a block's occurrences to the word spans (starts and ends in turn) and item ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = build(rows.value)
        for batch in batches:
            all_spans, all_items = [], []
            texts = batch.column(batch.schema.get_field_index(text))
            old_spans = batch.column(batch.schema.get_field_index(spans))
            old_items = batch.column(batch.schema.get_field_index(items))
            for i in range(batch.num_rows):
                words = split_words(texts[i].as_py() or "")
                found, named = [], set()
                if words and len(automaton):
                    keys = tuple(map(numbers.__getitem__, words))
                    for last, (size, ids) in automaton.iter(keys):
                        found.append((last + 1 - size, last + 1))
                        named.update(ids)
                if not found:
                    all_spans.append(old_spans[i].as_py())
                    all_items.append(old_items[i].as_py())
                    continue
                flat = old_spans[i].as_py() or []
                spans_now = merged([*zip(flat[::2], flat[1::2], strict=True), *found])
                all_spans.append([x for span in spans_now for x in span])
                all_items.append(sorted(named.union(old_items[i].as_py() or ())))
            for name, values, kind in ((spans, all_spans, SPANS), (items, all_items, ITEMS)):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, name, pa.array(values, kind))
            yield batch

    return scan


LEAKS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
SPAN_TYPE = T.StructType().add("start", T.LongType()).add("end", T.LongType())
LEAKS_TYPE = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("n_hit", T.LongType())
    .add("n_items", T.LongType())
    .add("items_sha256", T.StringType())
    .add("contaminated", T.BooleanType())
    .add("hits", T.ArrayType(SPAN_TYPE))
)


def leak(text: str | None, flat: list[int] | None, items: list[str] | None) -> dict:
    n_words = len(split_words(text or ""))
    flat = flat or []
    hits = []
    if flat:
        places = [m.span() for m in WORD.finditer(text or "")]
        hits = [
            {"start": places[a][0], "end": places[b - 1][1]}
            for a, b in zip(flat[::2], flat[1::2], strict=True)
        ]
    return {
        "n_words": n_words,
        "n_hit": sum(flat[1::2]) - sum(flat[::2]),
        "n_items": len(items or ()),
        "items_sha256": hashlib.sha256(",".join(items or ()).encode()).hexdigest(),
        "contaminated": bool(flat),
        "hits": hits,
    }


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, and a struct of counts and of hit spans in characters
    of the original text: ``leaks``, or the next free name, returned last."""
    spark = docs.sparkSession
    windows = item_windows(benchmark).persist()
    n_blocks = max(1, math.ceil(windows.count() / BLOCK_WINDOWS))
    spans, items, leaks = (free_name(docs, n) for n in ("leak_spans", "leak_items", "leaks"))
    columns = docs.columns
    found = docs.withColumn(spans, F.lit(None).cast("array<int>")).withColumn(
        items, F.lit(None).cast("array<string>")
    )
    for block in range(n_blocks):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        rows = spark.sparkContext.broadcast([(r.window, r.items) for r in mine.toLocalIterator()])
        found = found.mapInArrow(scan_block(rows, "text", spans, items), found.schema)
    windows.unpersist()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts, places, named = (batch.column(at(n)) for n in ("text", spans, items))
            values = [
                leak(texts[i].as_py(), places[i].as_py(), named[i].as_py())
                for i in range(batch.num_rows)
            ]
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(values, LEAKS)], names=[*columns, leaks]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(leaks, LEAKS_TYPE)])
    return found.mapInArrow(finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs; columns stay as they are."""
    found = find_leaks(docs, benchmark)
    clean = ~F.col(found.columns[-1])["contaminated"]
    return found.filter(clean).select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return found.select("doc_id", *(F.col("leaks")[f].alias(f) for f in fields))


# An equi-join of windows as strings.
ORACLE = r"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(list_slice(ws, s, s + 9), ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM items WHERE len(ws) > 0)),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS s FROM docs),
candidates AS (
  SELECT doc_id, s, z.size, array_to_string(list_slice(ws, s, s + z.size - 1), ' ') AS win
  FROM places JOIN (SELECT DISTINCT size FROM windows) z ON s + z.size - 1 <= len(ws)),
hits AS (SELECT c.doc_id, c.s, c.size, w.item FROM candidates c JOIN windows w ON c.size = w.size AND c.win = w.win),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
  coalesce(w.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words w USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
