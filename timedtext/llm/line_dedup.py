"""Line dedup by winnowing: runs of lines that stand earlier in the corpus are deleted.

A run is ``MIN_LINES`` or more consecutive lines with ink (blank lines do not count). A line
goes if it lies in a run of that length that also starts earlier: in a smaller ``doc_id``, or
higher up in the same document. Runs are judged on the input, so chains of copies all go.

Every window of ``MIN_LINES`` lines selects the least hash of the ``GRAM``-line grams in it, so
two equal runs always share a selected fingerprint. Only positions whose fingerprint stands
twice or more are joined; the windows that select it are grouped by their whole hashes and
reduced to their first place, which finds all runs without extending matches pair by pair. One row per window, never one per pair: a passage in
a third of all documents costs as many rows as it has copies.

With ``long_words`` a run of one or two lines also counts if it has that many words or more; the
query and the pipeline take ``LONG_WORDS``.

Defined results: null text is empty, it has no lines and stays null. Rows that agree in
``doc_id`` and text are one document and get the same result each; rows with one ``doc_id`` and
different texts are ordered by the hash of the text. A null ``doc_id`` comes before all others.
Only ``doc_id`` and ``text`` are read; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import SPACES, free_name, let, replace_text, table
from timedtext.session import stage_table

GRAM = 2
WINDOW = 2
MIN_LINES = GRAM + WINDOW - 1
LONG_WORDS = 50


def has_ink(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def inked(lines: Column) -> Column:
    """Indices of the lines with ink."""
    kept = F.transform(lines, lambda x, i: F.when(has_ink(x), i))
    return F.filter(kept, lambda i: i.isNotNull())


def gram(hashes: Column, i: Column, size: int, *seed: Column) -> Column:
    return F.xxhash64(*seed, *(F.get(hashes, i + k) for k in range(size)))


def windows_of(docs: DataFrame) -> DataFrame:
    """One row per window: its document, its index, its fingerprint and two hashes of it.

    ``lead`` marks the first window that selects a fingerprint's place.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))

    def selected(places: Column, grams: Column) -> Column:
        """Per window the index of its least gram; the first of equal ones."""
        return F.transform(
            F.slice(places, F.lit(1), F.greatest(F.size(grams) - WINDOW + 1, F.lit(0))),
            lambda i: F.array_min(
                F.array(*(F.struct(F.get(grams, i + k).alias("h"), (i + k).alias("p")) for k in range(WINDOW)))
            ),
        )

    def rows(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - GRAM + 1, F.lit(0))
        places = F.transform(hashes, lambda _, i: i)
        grams = F.transform(
            F.slice(hashes, F.lit(1), last), lambda _, i: F.xxhash64(*(F.get(hashes, i + k)["a"] for k in range(GRAM)))
        )

        def final(chosen: Column) -> Column:
            return F.transform(
                chosen,
                lambda c, i: F.struct(
                    i.alias("i"),
                    c["h"].alias("fp"),
                    ((i == 0) | (F.get(chosen, F.greatest(i - 1, F.lit(0)))["p"] != c["p"])).alias("lead"),
                    F.xxhash64(*(F.get(hashes, i + k)["a"] for k in range(MIN_LINES))).alias("a"),
                    F.xxhash64(*(F.get(hashes, i + k)["b"] for k in range(MIN_LINES))).alias("b"),
                ),
            )

        return let(let(grams, lambda g: selected(places, g)), final)

    hashes = F.transform(
        F.filter(lines_of(F.col("text")), has_ink),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")),
    )
    return docs.select(
        F.col("doc_id"), text_hash.alias("text_hash"), F.inline(let(hashes, rows))
    )


def long_runs(docs: DataFrame, long_words: int) -> DataFrame:
    """Places of the lines of later runs of one or two lines with ``long_words`` words or more."""

    def rows(lines: Column) -> Column:
        def of_size(size: int) -> Column:
            def run(_: Column, i: Column) -> Column:
                parts = [F.get(lines, i + k) for k in range(size)]
                return F.struct(
                    i.alias("i"),
                    F.lit(size).alias("size"),
                    F.xxhash64(*(x["a"] for x in parts)).alias("a"),
                    F.xxhash64(*(x["b"] for x in parts)).alias("b"),
                    sum((x["n"] for x in parts[1:]), parts[0]["n"]).alias("n"),
                )

            # Past the last line the sum is null, and the run goes.
            return F.filter(F.transform(lines, run), lambda x: x["n"] >= long_words)

        return F.concat(of_size(1), of_size(2))

    lines = F.transform(
        F.filter(lines_of(F.col("text")), has_ink),
        lambda x: F.struct(
            F.xxhash64(x).alias("a"),
            F.xxhash64(F.lit(1), x).alias("b"),
            F.size(F.filter(F.split(x, SPACES), lambda w: w != "")).alias("n"),
        ),
    )
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    runs = stage_table(docs.select("doc_id", text_hash, F.inline(let(lines, rows))), "long-runs")
    place = F.struct("doc_id", "text_hash", "i")
    first = runs.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n_runs")).filter("n_runs > 1")
    later = runs.join(first, ["size", "a", "b"]).filter(place > F.col("first"))
    return later.select("doc_id", "text_hash", F.explode(F.sequence("i", F.expr("i + size - 1"))).alias("line"))


def repeated_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """Per document with repeats: sorted indices, among its lines with ink, of what goes."""
    windows = stage_table(windows_of(docs), "line-windows")
    place = F.struct("doc_id", "text_hash", "i")
    common = (
        windows.filter("lead").groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    )
    matched = windows.join(common, "fp").select("doc_id", "text_hash", "i", "a", "b")
    first = matched.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    later = matched.join(first.filter("n > 1"), ["a", "b"]).filter(place > F.col("first"))
    gone = later.select("doc_id", "text_hash", F.explode(F.sequence("i", F.col("i") + MIN_LINES - 1)).alias("line"))
    if long_words is not None:
        gone = gone.union(long_runs(docs, long_words))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """All rows and columns; ``text`` without later repeated runs, and a struct ``line_dedup``
    (or the next free name, returned last) with n_lines, n_removed and n_runs."""
    columns = docs.columns
    gone = repeated_lines(docs.select("doc_id", "text"), long_words)
    id_name, hash_name, gone_name = (free_name(docs, n) for n in ("of_id", "of_text", "gone"))
    gone = gone.toDF(id_name, hash_name, gone_name)
    same = docs["doc_id"].eqNullSafe(gone[id_name]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[hash_name]
    )
    joined = docs.join(gone, same, "left")
    lines = lines_of(F.col("text"))
    removed = F.coalesce(F.col(gone_name), F.array().cast("array<int>"))

    def kept(all_lines: Column) -> Column:
        def without(ink: Column) -> Column:
            at = F.transform(removed, lambda j: F.get(ink, j))
            left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), at)
            return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

        return let(inked(all_lines), without)

    runs = let(
        removed,
        lambda r: F.size(F.filter(r, lambda x: x.isNotNull()))
        - F.size(F.filter(F.transform(r, lambda x, i: (i > 0) & (F.get(r, F.greatest(i - 1, F.lit(0))) == x - 1)), lambda x: x)),
    )
    name = free_name(joined, "line_dedup")
    text = F.when(F.size(removed) == 0, F.col("text")).otherwise(let(lines, kept))
    info = F.struct(
        F.when(F.col("text").isNull(), 0).otherwise(F.size(inked(lines))).cast("bigint").alias("n_lines"),
        F.size(removed).cast("bigint").alias("n_removed"),
        runs.cast("bigint").alias("n_runs"),
    )
    return replace_text(joined.withColumn(name, info), text).select(*columns, name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), LONG_WORDS)
    info = F.col("line_dedup")
    return found.select(
        "doc_id",
        *(info[f].alias(f) for f in ("n_lines", "n_removed", "n_runs")),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


# Windows as rows of a window function, without fingerprints.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, k, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS ink
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
inked AS (SELECT doc_id, k, line,
  len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM lines WHERE ink),
windows AS (
  SELECT doc_id, i, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM inked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS r
    FROM windows WHERE c IS NOT NULL) WHERE r > 1),
long AS (
  SELECT doc_id, i, 1 AS size, line AS a, NULL AS b FROM inked WHERE n >= 50
  UNION ALL
  SELECT doc_id, i, 2, a, b FROM (
    SELECT doc_id, i, line AS a, lead(line) OVER w AS b, n + lead(n) OVER w AS n
    FROM inked WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE n >= 50),
later_long AS (
  SELECT doc_id, i, size FROM (
    SELECT *, row_number() OVER (PARTITION BY size, a, b ORDER BY doc_id, i) AS r FROM long) WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later
  UNION SELECT doc_id, i FROM later_long UNION SELECT doc_id, i + 1 FROM later_long WHERE size = 2),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < i - 1) AS n_runs
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS text
  FROM lines l LEFT JOIN inked n ON l.doc_id = n.doc_id AND l.k = n.k
  LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i
  WHERE g.i IS NULL GROUP BY l.doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM inked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
