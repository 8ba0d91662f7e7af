import os

import pytest
from helpers import HARBOUR, LOOSE, cue_table
from pyspark.sql import functions as F

from timedtext.operators import compose
from timedtext.sources import files as fs

DECODED = "path string, text string, status string, message string"


def parse(spark, text):
    table = spark.createDataFrame([("f", text, "success", None)], DECODED)
    status = fs.parse_status(table).first()
    return fs.parse_cues(table).orderBy("cue").collect(), status


def test_cues_without_blank_lines_between(spark):
    rows, status = parse(spark, LOOSE)
    assert status.status == "success"
    assert [(r.cue, r["index"], r.start_ms, r.end_ms, r.content) for r in rows] == [
        (1, 3, 10200, 11000, "Two boats"),
        (2, 4, 60000, 69999, "left at dawn,\none with\nno oars"),
    ]


def test_variants(spark):
    text = (
        "﻿\n7\n00:00:01.5 --> 100:00:02:250 X1:40 align\nnumeric next\n42\n\n\n"
        "9\n00:00:03,000-->00:00:04,000\n\n\n11\n00:00:05,000 --> 00:00:06,000\nlast  \n\nwith gap\n\n"
    )
    rows, status = parse(spark, text)
    assert status.status == "success"
    assert [(r["index"], r.start_ms, r.end_ms, r.proprietary, r.content) for r in rows] == [
        (7, 1005, 360_002_250, "X1:40 align", "numeric next\n42"),
        (9, 3000, 4000, "", ""),
        (11, 5000, 6000, "", "last  \n\nwith gap"),
    ]


@pytest.mark.parametrize("text", ["no times at all", "junk\n\n" + LOOSE, "1\n00:00:01,000\nx"])
def test_not_a_subtitle_file(spark, text):
    rows, status = parse(spark, text)
    assert rows == [] and status.status == "error" and status.message.startswith("Failed to parse")


@pytest.mark.parametrize("text", ["", " \n\n"])
def test_empty_file_is_no_error(spark, text):
    rows, status = parse(spark, text)
    assert rows == [] and status.status == "success"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "cp874", "shift_jis"])
def test_scan_and_decode(spark, tmp_path, encoding):
    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\nสวัสดี\r\n" if encoding == "cp874" else LOOSE
    (tmp_path / "a.srt").write_bytes(text.encode(encoding))
    (tmp_path / "bad.srt").write_bytes(b"\xff\xfe\x00\x00\x80" if encoding != "cp874" else b"\xfc\xff")
    (tmp_path / "other.txt").write_text("x")
    files = fs.scan_files(spark, str(tmp_path))
    assert files.count() == 2
    rows = {r.path[-7:]: r for r in fs.decode_files(files, encoding.upper()).collect()}
    assert rows["bad.srt"].status == "error" and "Failed to decode" in rows["bad.srt"].message
    good = rows[[k for k in rows if k.endswith("a.srt") and k != "bad.srt"][0]]
    assert good.text == text.replace("\r\n", "\n")


def test_scan_without_matches(spark, tmp_path):
    assert fs.scan_files(spark, str(tmp_path), "*.srt").isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        fs.scan_files(spark, str(tmp_path / "none")).count()


def test_compose_sorts_numbers_and_skips(spark):
    cues = cue_table(
        spark,
        {"f": [(5000, 6000, "second\n\n\nline"), (1000, 2000, "first"), (3000, 4000, " \n"), (9000, 8000, "back")]},
    ).withColumn("proprietary", F.when(F.col("cue") == 2, "X:1").otherwise(""))
    expected = (
        "1\n00:00:01,000 --> 00:00:02,000 X:1\nfirst\n\n2\n00:00:05,000 --> 00:00:06,000\nsecond\nline\n\n"
    )
    for options in ({}, {"part_cues": 1, "slice_ms": 2000}):
        assert compose.compose_srt(cues, **options).first().text == expected


def test_compose_then_parse(spark):
    cues = cue_table(spark, {"a": HARBOUR, "b": HARBOUR[::-1]})
    texts = compose.compose_srt(cues).withColumn("status", F.lit("success"))
    back = fs.parse_cues(texts, "file_id").where("file_id = 'a'")
    same = cues.where("file_id = 'a'").select("file_id", "cue", "start_ms", "end_ms", "content", "proprietary")
    assert back.drop("index").exceptAll(same).isEmpty() and back.count() == 4


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.srt", bytearray(b"\xff\x00")), ("b.srt", bytearray(b"hi"))], "path string, content binary")
    for _ in range(2):  # the same again leaves the same files
        fs.write_named_files(rows, str(tmp_path))
    assert (tmp_path / "x" / "a.srt").read_bytes() == b"\xff\x00"
    assert sorted(os.listdir(tmp_path)) == ["b.srt", "x"] and os.listdir(tmp_path / "x") == ["a.srt"]


def test_text_parts_in_order(spark, tmp_path):
    """A large file is written by several tasks; its parts read in order are the text."""
    cues = cue_table(spark, {"f": [f"line {n}" for n in range(200)], "g": ["one"]})
    parts = compose.compose_parts(cues, part_cues=10).withColumnRenamed("file_id", "name")
    parts = parts.withColumn("name", F.concat("name", F.lit(".srt")))
    fs.write_text_parts(parts, str(tmp_path / "out"), "name")
    fs.write_text_parts(parts.where("name = 'g.srt'"), str(tmp_path / "out"), "name")  # again
    whole = {r.file_id: r.text for r in compose.compose_srt(cues).collect()}
    for name in ("f", "g"):
        folder = tmp_path / "out" / f"output={name}.srt"
        text = "".join((folder / p).read_text() for p in sorted(os.listdir(folder)) if p.startswith("part"))
        assert text == whole[name]


def test_snapshot(spark):
    cues = cue_table(spark, {"a": HARBOUR})
    marked = F.when(F.col("cue") == 1, "Primera línea")
    rows = compose.restore_cues(compose.snapshot_cues(cues, marked)).orderBy("cue").collect()
    assert [r.translated_content for r in rows] == ["Primera línea", None, None, None]
    assert [(r.start_ms, r.end_ms, r.content) for r in rows] == [tuple(c) for c in HARBOUR]


def same_hour(n):
    """Cues of one hour, most of them in one millisecond, some of these with one end."""
    rows = [(5 if i % 3 else 5 + i % 7, 9 if i % 2 else 9 + i % 11, f"c{i}") for i in range(n)]
    return [(s, max(s, e), c) for s, e, c in rows]


@pytest.mark.parametrize("slice_rows", [4, 32, 100_000])
def test_cues_of_one_hour_are_ranked_in_parts(spark, slice_rows):
    files = {"a": same_hour(300), "b": same_hour(40), "c": HARBOUR}
    rows = compose.number_by_time(cue_table(spark, files), slice_rows=slice_rows).collect()
    for name, cues in files.items():
        order = sorted(range(len(cues)), key=lambda i: (cues[i][0], cues[i][1], i))
        found = {r.cue - 1: r.number for r in rows if r.file_id == name}
        assert found == {at: number for number, at in enumerate(order, 1)}


def test_a_rank_is_over_few_cues(spark):
    """The largest group of the ranking window."""
    cues = cue_table(spark, {"a": same_hour(900)})
    text = compose.number_by_time(cues, slice_rows=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(file_id" in text and "part" in text.split("windowspecdefinition(", 1)[1].split(")")[0]
    parts = cues.selectExpr("start_ms", "end_ms", "cue div 16 AS block").groupBy("start_ms", "end_ms", "block").count()
    assert parts.agg(F.max("count")).first()[0] <= 16


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    (tmp_path / "old.srt").write_bytes(b"old")
    rows = spark.range(20).select(
        F.format_string("f%d.srt", "id").alias("path"),
        F.when(F.col("id") == 17, F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.lit(b"x")).alias("content"),
    )
    with pytest.raises(Exception, match="no more"):
        fs.write_named_files(rows.repartition(4), str(tmp_path))
    assert os.listdir(tmp_path) == ["old.srt"]
    fs.write_named_files(rows.where("id < 3"), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["f0.srt", "f1.srt", "f2.srt", "old.srt"]


@pytest.mark.parametrize("recursive", [False, True])
def test_a_crowded_folder_is_listed_by_tasks_and_gives_the_same(spark, tmp_path, monkeypatch, recursive):
    for name in ("a.srt", "b 1.srt", "c.txt", ".d.srt", "_e.srt", "sub/f.srt", ".sub/g.srt", "é.srt", "empty.srt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode() * 3)
    wanted = fs.scan_files(spark, str(tmp_path), "*.srt", recursive)
    monkeypatch.setattr(fs, "MOST_LISTED", 2)
    monkeypatch.setattr(fs, "READ_BYTES", 10)
    found = fs.scan_files(spark, f"file://{tmp_path}/", "*.srt", recursive)
    assert "binaryFile" in plan_of(wanted) and "binaryFile" not in plan_of(found)
    assert found.schema.names == wanted.schema.names
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, wanted.collect())) and len(rows) == 3 + recursive
    assert "ArrowEvalPython" not in plan_of(found.select("path"))


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


def test_a_task_tells_the_driver_its_folder_and_no_names(spark, tmp_path):
    assert list(fs.Staged.__dataclass_fields__) == ["folder"]
    rows = spark.range(50).select(F.format_string("%d/f%d.srt", F.col("id") % 3, "id").alias("path"), F.lit("x").alias("content"))
    fs.write_named_files(rows.repartition(4), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["0", "1", "2"]
    assert sum(len(os.listdir(tmp_path / folder)) for folder in "012") == 50


def test_parts_of_a_mounted_folder_replace_old_ones(spark, tmp_path):
    def write(rows):
        fs.write_text_parts(spark.createDataFrame(rows, "output string, part bigint, text string"), str(tmp_path))

    def read(name):
        folder = tmp_path / f"output={name}"
        return [(folder / p).read_text() for p in sorted(os.listdir(folder)) if p.startswith("part-")]

    write([("a b%.srt", 0, "old\n\n"), ("keep.srt", 0, "kept\n\n")])
    write([("a b%.srt", n, f"{n}\n\n") for n in range(40)])
    assert "".join(read("a b%25.srt")) == "".join(f"{n}\n\n" for n in range(40))
    assert read("keep.srt") == ["kept\n\n"]
    assert not [name for _, _, names in os.walk(tmp_path) for name in names if name.endswith(".crc")]


def test_listing_takes_few_tasks(spark, tmp_path):
    spark.conf.set(fs.LISTING_TASKS, "9999")
    (tmp_path / "a.srt").write_text("x")
    assert fs.scan_files(spark, str(tmp_path)).count() == 1
    assert int(spark.conf.get(fs.LISTING_TASKS)) == 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(fs.LISTING_TASKS, "3")
    fs.few_listing_tasks(spark)
    assert spark.conf.get(fs.LISTING_TASKS) == "3"
    spark.conf.unset(fs.LISTING_TASKS)


def test_parsing_is_one_expression(spark, tmp_path):
    """A filter on the parsed text did the parsing again for each of its terms; and the pattern of
    a cue walked through its content."""
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    frame = fs.parse_cues(fs.decode_files(fs.scan_files(spark, str(tmp_path))))
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert text.count(r"split(rtrim(regexp_replace(") == 1
    assert r"[\s\S]" not in text
    head = "7\n0:00:01,0 --> 0:00:02,0"
    bodies = ["", "\n", " note", " note\n\n\n", "\nx\n\n", "\n\n\nx\x01y\n z \n\n\n", "\t \n \n"]
    files = spark.createDataFrame([(n, head + b, "success") for n, b in enumerate(bodies)], "path int, text string, status string")
    rows = fs.parse_cues(files.unionByName(spark.createDataFrame([(9, "none", "success"), (10, None, "error")], files.schema)))
    assert [(r.file_id, r.proprietary, r.content) for r in rows.orderBy("file_id").collect()] == [
        (0, "", ""), (1, "", ""), (2, "note", ""), (3, "note", ""), (4, "", "x"), (5, "", "\n\nx\x01y\n z "), (6, "", " ")
    ]
