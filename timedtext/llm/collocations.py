"""Phrase collocations by relational mining of occurrences (SETM).

The *occurrence relation* of length k has a row for each text with the numbers of its frequent
k-word phrases in the order of their places; ``GAP`` stands where the next place has no frequent
phrase or where a piece ends, so two numbers side by side are adjacent places of one piece. Each
relation is persisted as Parquet. One length follows from the one before:

1. *Merge join by piece and adjacent position*: the phrases at places i and i + 1 make the phrase
   of k + 1 words at i. Both lie side by side in the sorted row, so the join is one scan of it.
2. *Group and count*: tasks count their own phrases, Spark adds the counts by phrase.
3. *Semi-join*: only occurrences of frequent phrases go into the next relation. The frequent ones
   are broadcast where there are at most ``HELD`` of them; beyond that, occurrences become rows
   and are joined with them by Spark.

A phrase of k + 1 words is the exact pair of the 32-bit numbers of its first and its last k words;
words are numbered by a 64-bit hash of language and word (two words of one hash would be mixed up;
with 100 million words that has a chance of 3e-4, and only if one of them is frequent does it matter).
A frequent phrase inside a longer one that is as frequent is also inside one that is one word
longer, since counts fall with length; so only these are compared.

Defined results: a null text is empty, a null ``lang`` is ``und`` (as is the language of that
name). Rows are texts of their own whatever their ``doc_id``. Only ``lang`` and ``text`` are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timedtext.llm.common import table
from timedtext.llm.hashing import Prefix, mix
from timedtext.session import stage_table

LEAST = 100
LONGEST = 5
TOP = 2000
HELD = 4_000_000  # frequent phrases of one length in a broadcast: 48 MB
GAP = -1
CHUNK_BYTES = 1 << 20
PENDING = 1_500_000
RELATION = "row bigint, ids binary"

# 0: in a word, 1: between words, 2: between pieces
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2


def language_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Words:
    """The words of some texts: where they stand, their text and keys, and which of them begin a
    piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.raw = b"\n".join(t.lower() for t in texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        kind = KIND[data]
        edge = np.diff((kind != 0).astype(np.int8), prepend=1)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        self.opens = np.diff(breaks[self.start], prepend=-1) > 0
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, "right")
        seeds = np.array([language_seed(x) for x in langs], np.uint64)
        self.key = mix(Prefix(data).ranges(self.start, self.end) ^ seeds[self.text]).astype(np.int64)

    def word(self, at: int) -> bytes:
        return self.raw[self.start[at] : self.end[at]]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[str]]]:
    """Consecutive texts of some ``CHUNK_BYTES`` together, with the first one's place."""
    langs = batch.column("lang").to_pylist()
    texts = batch.column("text")
    part: list[bytes] = []
    size = first = 0
    for i in range(batch.num_rows):
        part.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= CHUNK_BYTES or i + 1 == batch.num_rows:
            yield first, part, langs[first : i + 1]
            part, size, first = [], 0, i + 1


WORD_COUNTS = "lang string, word string, key bigint, n bigint"


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts, and for each language a row without a word that has
    the number of all its words."""
    keys, counts, langs, words = [], [], [], []
    totals: dict[str, int] = {}

    def reduced():
        key, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        return key, n, [langs[i] for i in first], [words[i] for i in first]

    def rows(key, n, lang, word):
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(key), pa.array(n)],
            names=["lang", "word", "key", "n"],
        )

    for batch in batches:
        for _, texts, of in chunks(batch):
            w = Words(texts, of)
            key, first, n = np.unique(w.key, return_index=True, return_counts=True)
            keys.append(key)
            counts.append(n)
            langs.extend(of[t] for t in w.text[first])
            words.extend(map(w.word, first))
            for text, n_words in zip(*np.unique(w.text, return_counts=True), strict=True):
                totals[of[text]] = totals.get(of[text], 0) + int(n_words)
            if len(words) >= PENDING:
                key, n, langs, words = reduced()
                if len(words) >= PENDING // 2:
                    yield rows(key, n, langs, words)
                    keys, counts, langs, words = [], [], [], []
                else:
                    keys, counts = [key], [n]
    if words:
        yield rows(*reduced())
    yield rows(np.zeros(len(totals), np.int64), np.array(list(totals.values()), np.int64), list(totals), [None] * len(totals))


class Frequent:
    """Numbers of frequent phrases by key, in memory."""

    def __init__(self, rows: DataFrame):
        found = rows.select("key", "id").toArrow()
        key, number = found["key"].to_numpy(), found["id"].to_numpy().astype(np.int32)
        order = np.argsort(key)
        self.key, self.number = key[order], number[order]

    def ids(self, key: np.ndarray) -> np.ndarray:
        """The numbers of keys, ``GAP`` where a key is not frequent."""
        if not len(self.key):
            return np.full(len(key), GAP, np.int32)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.number[at], GAP).astype(np.int32)


def as_rows(ids: np.ndarray, of: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Rows of the relation from numbers with the index of their text; runs of gaps shrink to one
    and none opens or ends a row."""
    last = np.concatenate([[True], (ids[:-1] == GAP) | (of[1:] != of[:-1])]) if len(ids) else np.zeros(0, bool)
    keep = ~((ids == GAP) & last)
    ids, of = ids[keep], of[keep]
    found, first = np.unique(of, return_index=True)
    parts = [p[:-1] if len(p) and p[-1] == GAP else p for p in np.split(ids, first[1:])] if len(found) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(names[found], pa.int64()), pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())],
        names=["row", "ids"],
    )


def with_gaps(opens: np.ndarray, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A gap before every number that opens a piece."""
    at = np.flatnonzero(opens)
    return np.insert(ids, at, GAP), np.insert(of, at, of[at])


def first_relation(held) -> Callable:
    """Frequent words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for batch in batches:
            names = batch.column("row").to_numpy()
            for first, texts, langs in chunks(batch):
                w = Words(texts, langs)
                ids, of = with_gaps(w.opens, frequent.ids(w.key), w.text)
                yield as_rows(ids, of, names[first : first + len(texts)])

    return run


def adjacent(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the relation in parts: keys of neighbouring numbers (``GAP`` where there are
    none), the index of their text, and the texts' names."""
    names, blobs = batch.column("row").to_numpy(), batch.column("ids")
    size = first = 0
    parts: list[np.ndarray] = []
    for i in range(batch.num_rows):
        ids = np.frombuffer(blobs[i].as_py(), "<i4").astype(np.int64)
        parts.append(np.append(ids, GAP))
        size += len(ids)
        if size >= CHUNK_BYTES or i + 1 == batch.num_rows:
            ids = np.concatenate(parts)
            of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            pair = (ids[:-1] << 32) | ids[1:]
            pair[(ids[:-1] == GAP) | (ids[1:] == GAP)] = GAP
            yield pair, of[:-1], names[first : i + 1]
            parts, size, first = [], 0, i + 1


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of one more word with their counts in this task."""
    keys, counts, size = [], [], 0

    def reduced():
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)

    def rows(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    for batch in batches:
        for pair, _, _ in adjacent(batch):
            key, n = np.unique(pair[pair != GAP], return_counts=True)
            keys.append(key)
            counts.append(n)
            size += len(key)
            if size >= PENDING:
                key, n = reduced()
                if len(key) >= PENDING // 2:
                    yield rows(key, n)
                    keys, counts, size = [], [], 0
                else:
                    keys, counts, size = [key], [n], len(key)
    if size:
        yield rows(*reduced())


def next_relation(held) -> Callable:
    """Frequent phrases of one more word of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for batch in batches:
            for pair, of, names in adjacent(batch):
                yield as_rows(frequent.ids(pair), of, names)

    return run


OCCURRENCES = "row bigint, place int, key bigint"


def word_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word; places skip a number where a piece begins."""
    for batch in batches:
        names = batch.column("row").to_numpy()
        for first, texts, langs in chunks(batch):
            w = Words(texts, langs)
            place = np.arange(len(w.key)) + np.cumsum(w.opens)
            yield occurrence_rows(names[first + w.text], place, w.key)


def pair_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each phrase of one more word."""
    for batch in batches:
        for pair, of, names in adjacent(batch):
            place = np.flatnonzero(pair != GAP)
            yield occurrence_rows(names[of[place]], place, pair[place])


def occurrence_rows(names: np.ndarray, place: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(place.astype(np.int32)), pa.array(key, pa.int64())],
        names=["row", "place", "key"],
    )


def sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and numbers of each text, in order, as rows of the relation."""
    for batch in batches:
        for row, found in zip(batch.column("row").to_pylist(), batch.column("found").to_pylist(), strict=True):
            place = np.array([f["place"] for f in found])
            ids = np.array([f["id"] for f in found], np.int32)
            opens = np.diff(place, prepend=place[0] - 1) > 1
            ids, of = with_gaps(opens, ids, np.zeros(len(ids), np.int64))
            yield as_rows(ids, of, np.array([row]))


def semi_join(occurrences: DataFrame, frequent: DataFrame) -> DataFrame:
    """The relation of the occurrences whose key is frequent, without a broadcast."""
    kept = occurrences.join(frequent.select("key", "id").hint("merge"), "key")
    found = F.array_sort(F.collect_list(F.struct("place", "id"))).alias("found")
    return kept.groupBy("row").agg(found).mapInArrow(sorted_rows, RELATION)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with numbers from 0 without holes as ``id``, staged. One count for each partition
    comes to the driver."""
    rows = stage_table(rows.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())
    first, total = {}, 0
    for p, n in counts:
        first[p] = total
        total += n
    if total >= 1 << 31:
        raise ValueError("more than 2^31 frequent phrases of one length")
    spark = rows.sparkSession
    starts = spark.createDataFrame(list(first.items()), "part bigint, first bigint")
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), part == F.col("part")).withColumn("id", F.col("first") + inside).drop("at", "part", "first")


def relation(source: DataFrame, frequent: DataFrame, number: int, lookup: Callable, rows: Callable, held: int) -> DataFrame:
    """The next occurrence relation, persisted."""
    spark = source.sparkSession
    if number <= held:
        broadcast = spark.sparkContext.broadcast(Frequent(frequent))
        out = stage_table(source.mapInArrow(lookup(broadcast), RELATION), "occurrences")
        broadcast.unpersist()
        return out
    return stage_table(semi_join(source.mapInArrow(rows, OCCURRENCES), frequent), "occurrences")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of one to ``longest`` words (lang, phrase, size, f, inside; inside: a
    phrase of one more word is as frequent), and all words of each language (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = texts.mapInArrow(word_counts, WORD_COUNTS).groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    counts = stage_table(counts.filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counts.filter("word IS NULL").select("lang", "n")
    frequent = numbered(counts.filter("word IS NOT NULL"), "frequent")
    known = frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    number = frequent.count()
    places = relation(texts, frequent, number, first_relation, word_occurrences, held)
    out = []
    for size in range(2, longest + 1):
        counts = places.mapInArrow(pair_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        frequent = numbered(counts.filter(F.col("n") >= least), "frequent")
        number = frequent.count()
        first, last = F.shiftright("key", 32), F.col("key").bitwiseAND((1 << 32) - 1)
        ends = frequent.select(F.explode(F.array(first, last)).alias("id"), "n")
        longer = ends.groupBy("id").agg(F.max("n").alias("longer"))
        out.append(
            known.join(longer, "id", "left").select(
                "lang",
                "phrase",
                F.lit(size - 1).alias("size"),
                "f",
                F.coalesce(F.col("longer") >= F.col("f"), F.lit(False)).alias("inside"),
            )
        )
        start = known.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("start"))
        end = known.select(F.col("id").alias("last"), F.substring_index("phrase", " ", -1).alias("word"))
        pairs = frequent.select("id", first.alias("first"), last.alias("last"), F.col("n").alias("f"))
        named = pairs.join(start, "first").join(end, "last")
        known = stage_table(named.select("id", "lang", F.concat_ws(" ", "start", "word").alias("phrase"), "f"), "phrases")
        if size < longest:
            places = relation(places, frequent, number, next_relation, pair_occurrences, held)
    out.append(known.select("lang", "phrase", F.lit(longest).alias("size"), "f", F.lit(False).alias("inside")))
    found = out[0]
    for rows in out[1:]:
        found = found.union(rows)
    return stage_table(found, "phrases"), totals


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of 38 digits."""
    wide = "decimal(38,0)"
    over = (F.lit(1000).cast(wide) * a.cast(wide)).cast(wide) * n.cast(wide)
    under = left.cast(wide) * right.cast(wide)
    return F.call_function("div", over.cast(wide), under.cast(wide))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, held: int = HELD
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = phrases(docs, least, longest, held)
    cut = (
        found.filter("size > 1 AND NOT inside")
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("start", F.expr("substring_index(phrase, ' ', cut)"))
        .withColumn("rest", F.expr("substring_index(phrase, ' ', cut - size)"))
    )
    left = found.select("lang", F.col("phrase").alias("start"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "start"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", exact_score(F.col("f"), F.col("n"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    scored = scored.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(lowest)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))
  WHERE len(words) > 0
),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, size, list_aggregate(words[i : i + size - 1], 'string_agg', ' ') AS phrase, words[i : i + size - 1] AS w
  FROM (
    SELECT lang, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i
    FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size)
    WHERE len(words) >= size)
),
counted AS (SELECT lang, phrase, size, any_value(w) AS w, count(*) AS f FROM grams GROUP BY lang, phrase, size HAVING count(*) >= 100),
parts AS (
  SELECT c.lang, c.size, c.f, list_aggregate(c.w[s : e], 'string_agg', ' ') AS phrase
  FROM counted c, generate_series(1, 5) AS x(s), generate_series(1, 5) AS y(e)
  WHERE s <= e AND e <= c.size AND e - s + 1 < c.size
),
open AS (
  SELECT * FROM counted c WHERE size > 1 AND NOT EXISTS (
    SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.f >= 100 * c.f)
),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, t.n,
    ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM open c
  JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < c.size
  JOIN counted l ON l.lang = c.lang AND l.phrase = list_aggregate(c.w[1 : k], 'string_agg', ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = list_aggregate(c.w[k + 1 : c.size], 'string_agg', ' ')
  JOIN totals t ON t.lang = c.lang
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best WHERE nth = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""
