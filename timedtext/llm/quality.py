"""Line-first quality rules: bad lines go, then documents that lost too much.

Every rule is a column expression on one row; nothing is shuffled.

Defined results: a null text has no words and no lines; it fails the base rules, as an empty
one does. A null ``doc_id`` is kept as it is. Equal rows get equal results, one each. Only
``doc_id`` and ``text`` are read, so further columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import SPACES, free_name, let, replace_text, table

SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Rule values of the method.
NAV_MARKS = "|»›·•"
NAV_LEAST = 3
SYMBOL_SHARE = 0.1
SHORT_LINE = 20
END_MARKS = r"""[.!?…:;,"'”’»)\]。！？।؟۔][\x20\x09-\x0D]*\z"""
BOILERPLATE = (
    r"all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|click here|"
    r"read more|sign up|log ?in|subscribe to|share this|skip to content|back to top"
)
BOILERPLATE_CHARS = 200
MIN_WORDS = 50
MAX_LOSS = 0.5


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text."""

    def covered(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            def same(row: Column, j: Column) -> Column:
                before = (j > 0) & (F.get(rows, F.greatest(j - 1, F.lit(0)))["h"] == row["h"])
                return before | F.coalesce(F.get(rows, j + 1)["h"] == row["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, same), lambda row: row["i"]))

        def total(starts: Column) -> Column:
            steps = F.transform(
                starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3)))
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(marked, twice), total)

    last = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(
        F.slice(words, F.lit(1), last),
        lambda word, i: F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)),
    )


def line_fails(line: Column) -> Column:
    """Navigation, boilerplate, symbols, or a short line without an end mark; never a blank one."""
    size = F.length(line)
    navigation = count_of(line, NAV_MARKS) >= NAV_LEAST
    symbols = count_of(line, SYMBOLS) >= SYMBOL_SHARE * size
    boilerplate = (size <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE)
    unended = (size < SHORT_LINE) & ~line.rlike(END_MARKS)
    return (count_of(line, SPACE_CHARS) < size) & (navigation | symbols | boilerplate | unended)


def assess(text: Column) -> Column:
    """All counts, the cleaned text and the verdict as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeat_words(words).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: count_of(x, SPACE_CHARS) < F.length(x))
        return F.struct(
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n").alias("clean"),
        )

    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(F.split(text, "\n"), of_lines).alias("l"),
        (F.length(text) - count_of(text, SPACE_CHARS)).cast("bigint").alias("word_chars"),
        count_of(text, SYMBOLS).cast("bigint").alias("n_symbols"),
    )


def judged(docs: DataFrame, min_words: int = MIN_WORDS, max_loss: float = MAX_LOSS) -> DataFrame:
    """Adds one struct column ``quality`` (or the next free name, returned last) to every row."""
    name = free_name(docs, "quality")
    raw = free_name(docs, "assessed")
    docs = docs.withColumn(raw, assess(F.col("text")))
    a = F.col(raw)
    n_words, repeats = a["w"]["n_words"], a["w"]["n_repeat_words"]
    failed = (n_words < min_words) | (100 * repeats > 50 * n_words)
    clean = a["l"]["clean"]
    left = F.length(clean) - count_of(clean, SPACE_CHARS)
    lost = (a["word_chars"] - left) > max_loss * a["word_chars"]
    return docs.withColumn(
        name,
        F.struct(
            n_words.alias("n_words"),
            a["word_chars"].alias("word_chars"),
            a["n_symbols"].alias("n_symbols"),
            a["l"]["n_dup_lines"].alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
            (a["word_chars"] - left).cast("bigint").alias("lost_chars"),
            clean.alias("clean"),
        ),
    ).drop(raw)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; columns stay as they are."""
    columns = docs.columns
    found = judged(docs)
    q = F.col(found.columns[-1])
    return replace_text(found.filter(q["kept"]), q["clean"]).select(*columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept lost_chars".split()
    )
    return found.select("doc_id", *(F.col("quality")[f].alias(f) for f in fields))


# Independent of the column expressions: words and windows as rows.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM docs)),
triples AS (
  SELECT doc_id, p, word AS a, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
repeated AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM triples WHERE c IS NOT NULL)
  WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, length(line) AS size, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS inked
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
of_lines AS (
  SELECT doc_id, count(*) FILTER (inked > 0) - count(DISTINCT line) FILTER (inked > 0) AS n_dup_lines,
    coalesce(sum(inked) FILTER (
      length(regexp_replace(line, '[^|»›·•]', '', 'g')) >= 3
      OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= 0.1 * size
      OR (size <= 200 AND regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|click here|read more|sign up|log ?in|subscribe to|share this|skip to content|back to top'))
      OR (size < 20 AND NOT regexp_matches(line, '[.!?…:;,"''”’»)\]。！？।؟۔][\x20\x09-\x0D]*$'))
    ), 0) AS lost_chars
  FROM (SELECT * FROM lines) GROUP BY doc_id),
joined AS (
  SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.word_chars, 0) AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    l.n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, l.lost_chars
  FROM docs d JOIN of_lines l USING (doc_id) LEFT JOIN counted k USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost_chars > 0.5 * word_chars) AS kept,
  CAST(lost_chars AS BIGINT) AS lost_chars
FROM joined
"""
