"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The two word definitions of the contracts, as classes of what is no word.
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BATCH_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, although the body uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(table: DataFrame, base: str) -> str:
    """A column name that the table does not have in any spelling of case."""
    taken = {c.lower() for c in table.columns}
    while base.lower() in taken:
        base += "_"
    return base


def replace_text(docs: DataFrame, text: Column) -> DataFrame:
    """The same columns with another text, and its length where the table has ``n_chars``."""
    docs = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs


def similar_sets_sql(size: int, percent: int) -> str:
    """DuckDB's ``found`` (doc_id, n_shingles, component_id): components of documents whose sets of
    ``size``-word shingles are similar by ``percent``, from an equi-join of all shingles."""
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(list_slice(ws, i, i + {size - 1}), ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM docs WHERE len(ws) >= {size})
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND {size - 1})),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
found AS (
  SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles,
    coalesce(min(r.other), d.doc_id) AS component_id
  FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id)
"""
