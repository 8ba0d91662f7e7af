import pytest
from helpers import OVEN, cue_table, plain_alignment, plain_pieces, plain_sentences, random_contents
from pyspark.sql import functions as F

from timedtext.operators import align, project
from timedtext.operators import sentences as sen

FILES = {f"f{i}": random_contents(i + 100) for i in range(20)} | {"one": ["Hello. World."]}


def translated(spark, files=FILES):
    return sen.sentence_cues(cue_table(spark, files), block_rows=6).withColumn(
        "translated", F.concat(F.replace("sentence", F.lit("o"), F.lit("o o")), F.lit("_x"))
    )


@pytest.mark.parametrize("space", [False, True])
def test_compat_pieces(spark, space):
    rows = project.project_translation(translated(spark), "compat", space=space).collect()
    mine = {(r.file_id, r.cue): r.piece for r in rows}
    assert len(mine) == len(rows)
    for name, contents in FILES.items():
        found = plain_alignment(contents)
        for number, sentence in enumerate(plain_sentences(contents), 1):
            ends = [(cue, hit[1]) for cue, hit in found.items() if hit and hit[0] == number]
            text = sentence.replace("o", "o o") + "_x"
            if ends:
                pieces = plain_pieces(text, [rel for _, rel in ends], space)
                assert [mine[name, cue] for cue, _ in ends] == pieces


@pytest.mark.parametrize("space", [False, True])
def test_lossless_pieces_join_to_the_sentence(spark, space):
    table = translated(spark)
    pieces = project.project_translation(table, "lossless", space=space)
    joined = pieces.groupBy("file_id", "sen").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue", "piece"))), lambda p: p.piece), "").alias("all")
    )
    both = table.where("kept").join(joined, ["file_id", "sen"], "left")
    assert both.where("all IS NULL OR all <> translated").isEmpty()


def test_sentence_without_a_cue(spark):
    table = translated(spark, {"one": ["Hello. World."]}).withColumn("translated", F.col("sentence"))
    compat = project.project_translation(table, "compat").collect()
    assert [r.piece for r in compat] == ["World."]
    whole = project.join_pieces(project.project_translation(table)).collect()
    assert [r.translated for r in whole] == ["Hello. World."]


def test_three_parts_of_a_long_sentence(spark):
    text = "We were told that every boat had left the port by now"
    row = [("f", 1, text, 0, 53, 1, True, [(1, 15), (2, 30), (3, 52)], text)]
    table = spark.createDataFrame(
        row,
        "file_id string, sen bigint, sentence string, sen_start bigint, sen_end bigint, first_cue bigint,"
        " kept boolean, ends array<struct<cue: bigint, rel: bigint>>, translated string",
    )
    parts = project.project_translation(table, space=True).orderBy("cue").collect()
    assert len(parts) == 3 and "".join(r.piece for r in parts) == text
    assert all(r.piece.endswith(" ") for r in parts[:2])


def test_missing_translation_is_empty(spark):
    table = translated(spark).withColumn("translated", F.lit(None).cast("string"))
    for mode in project.MODES:
        rows = project.project_translation(table, mode, space=True)
        assert rows.where("piece <> ''").isEmpty() and not rows.isEmpty()
    with pytest.raises(ValueError):
        project.project_translation(table, "other")


def lines_and_texts(spark):
    lines = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x")],
        "file_id string, line_no bigint, line string",
    )
    texts = spark.createDataFrame(
        [("a", "Noche clara\nTodos se sientan ya."), ("b", "eins\nzwei\n"), ("c", "uno")],
        "file_id string, text string",
    )
    return lines, texts


def test_attach_lines(spark):
    lines, texts = lines_and_texts(spark)
    rows = project.attach_lines(lines, texts.where("file_id <> 'c'")).orderBy("file_id", "line_no")
    assert [r.translated for r in rows.collect()] == ["Noche clara", "Todos se sientan ya.", "eins", ""]
    kept = project.attach_lines(lines, texts, "skip")
    assert {r.file_id for r in kept.collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        project.attach_lines(lines, texts, "other")


def test_count_guard(spark):
    lines, texts = lines_and_texts(spark)
    rows = {r.file_id: r for r in project.count_guard(lines, project.split_lines(texts)).collect()}
    assert rows["a"].status == "success" and rows["a"].message is None
    assert rows["b"].message == "3 lines for 1 cues"
    alone = project.count_guard(cue_table(spark, {"z": OVEN}), project.split_lines(texts.limit(0)))
    assert alone.first().message == "0 lines for 2 cues"


def test_compose_cues(spark):
    cues = cue_table(spark, {"b": OVEN}).withColumn("translated", F.lit("Hola"))
    rows = project.compose_cues(cues).orderBy("cue").collect()
    assert rows[1].content == "Hola\nOnly the oven. It hums"
    assert project.compose_cues(cues, both=False).first().content == "Hola"


def test_alignment_needs_no_second_row_per_cue(spark):
    rows = align.explode_alignment(translated(spark)).groupBy("file_id", "cue").count()
    assert rows.where("count > 1").isEmpty()
