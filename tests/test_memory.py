import re

from pyspark.sql import functions as F

from timedtext.operators import memory

LINES = "file_id string, line_no bigint, src_lang string, tgt_lang string, line string"
PAIRS = "src_lang string, tgt_lang string, text string, translated string"


def tables(spark):
    lines = spark.createDataFrame(
        [("a", 1, "en", "es", "Hello"), ("a", 2, "en", "es", "  "), ("a", 3, "en", "fr", "Hello"), ("b", 1, "en", "es", "New")],
        LINES,
    )
    pairs = spark.createDataFrame(
        [("en", "es", "Hello", "Hola"), ("en", "es", "Hello", "Hola"), ("en", "fr", "Bye", "Salut"), ("en", "es", " ", "?")],
        PAIRS,
    )
    return lines, memory.build_memory(pairs)


def test_lookup(spark):
    lines, known = tables(spark)

    def found(on_miss):
        rows = memory.lookup_translations(lines, known, "line", on_miss)
        return [r.translated for r in rows.orderBy("file_id", "line_no").collect()]

    assert found("empty") == ["Hola", "", "", ""]
    assert found("source") == ["Hola", "", "Hello", "New"]
    assert found("null") == ["Hola", "", None, None]


def test_misses(spark):
    rows = memory.memory_misses(*tables(spark), "line").collect()
    assert {(r.tgt_lang, r.text) for r in rows} == {("fr", "Hello"), ("es", "New")}


def test_hot_text_is_split(spark, tmp_path):
    """A text that is most of all lines does not end in one task."""
    lines = spark.range(0, 400_000, 1, 8).select(
        F.col("id").cast("string").alias("file_id"),
        F.lit("en").alias("src_lang"),
        F.lit("es").alias("tgt_lang"),
        F.when(F.col("id") % 10 < 7, "Yes.").otherwise(F.concat(F.lit("line "), "id")).alias("line"),
    )
    lines.write.parquet(str(tmp_path / "lines"))
    known = lines.select("src_lang", "tgt_lang", F.col("line").alias("text")).distinct()
    known.withColumn("translated", F.upper("text")).write.parquet(str(tmp_path / "memory"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = memory.lookup_translations(
            spark.read.parquet(str(tmp_path / "lines")), spark.read.parquet(str(tmp_path / "memory")), "line"
        )
        rows = found.select(F.xxhash64("file_id", "translated").alias("h"), "line", "translated")
        assert rows.where("translated = upper(line)").collect().__len__() == 400_000
        query = rows.where("translated = upper(line)")
        query.collect()
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin\(skew=true\)|isSkew|skewed", plan)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_extract(spark):
    nested = '[[["Noche clara","Quiet night"],["mas lejos ","rest"]], "more"]'
    raws = [
        (1, "array", nested),
        (2, "array", "invalid json"),
        (3, "array", "[]"),
        (4, "cloud", '{"data": {"translations": [{"translatedText": "Noche clara"}]}}'),
        (5, "cloud", '{"data": {"translations": []}}'),
        (6, "array_all", nested),
        (7, "array_all", '[[["a","x"],[""],[null],["b"]]]'),
        (8, "sentences", '{"sentences":[{"trans":"a"},{"orig":"x"},{"trans":"b"}]}'),
        (9, "array", '[[[null],["tail"]]]'),
        (10, "array", '[[["one"]]]'),
        (11, "sentences", "[1]"),
        (12, "cloud", '{"data": {"translations": [{}]}}'),
    ]
    table = spark.createDataFrame(raws, "request_id bigint, layout string, raw string")
    rows = {r.request_id: r for r in memory.extract_translations(table).collect()}
    texts = {k: r.translated for k, r in rows.items()}
    assert texts == {
        1: "Noche clara", 2: None, 3: None, 4: "Noche clara", 5: None, 6: "Noche claramas lejos ",
        7: "ab", 8: "ab", 9: None, 10: "", 11: None, 12: "",
    }
    assert rows[2].message == "Not JSON"
    assert rows[3].message == "No translation in the response"
    assert rows[1].status == "success" and rows[1].message is None
