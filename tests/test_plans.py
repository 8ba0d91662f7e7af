"""What the plans must and must not contain."""

import re

import pytest
from conftest import SF_DIR

from timedtext.operators.sentences import sentences
from timedtext.plans.queries import QUERIES, turn_cues

NO_PYTHON = re.compile("ArrowEvalPython|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas")


def plan(spark, frame):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize(
    "name",
    [
        "sentences",
        "align_cues",
        "align_offsets",
        "alignment_audit",
        "project_lossless",
        "translate_split_compat",
        "translate_split_lossless",
        "translate_naive",
        "lookup_translations",
        "compose_srt",
        "cue_offsets",
    ],
)
def test_no_nested_loops_and_no_python(no_broadcast, name):
    text = plan(no_broadcast, QUERIES[name](no_broadcast, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert not NO_PYTHON.search(text)


@pytest.mark.parametrize("name", ["turn_sentences", "turn_alignment"])
def test_cue_rows_meet_by_block_only(no_broadcast, name):
    """Wherever rows are shuffled by the file alone, they are one row per block."""
    frame = QUERIES[name](no_broadcast, SF_DIR)
    text = plan(no_broadcast, frame)
    by_file = re.findall(r"hashpartitioning\(file_id#\d+L?, \d+\)", text)
    by_block = re.findall(r"hashpartitioning\(file_id#\d+L?, block#\d+L?, \d+\)", text)
    assert len(by_file) == 1 and len(by_block) >= 2
    at = text.index(by_file[0])
    assert "text#" not in text[text.rindex("Exchange", 0, at) : at]


def test_cues_are_shuffled_once_for_both_uses(no_broadcast):
    frame = sentences(turn_cues(no_broadcast, SF_DIR), block_rows=4)
    frame.collect()
    assert "ReusedExchange" in plan(no_broadcast, frame)


def test_files_of_one_block_need_no_join(no_broadcast):
    frame = QUERIES["turn_sentences"](no_broadcast, SF_DIR)
    frame.collect()
    final = plan(no_broadcast, frame).split("Initial Plan")[0]
    assert "Join" not in final


def test_sentences_of_files_of_one_block_are_not_shuffled(no_broadcast):
    """Their cues lie together by block; before, every sentence was shuffled once more."""
    frame = QUERIES["turn_sentences"](no_broadcast, SF_DIR)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"hashpartitioning\(file_id#\d+L?, block#", final)
    assert not re.search(r"hashpartitioning\(file_id#\d+L?, sen#", final)


def test_only_needed_columns_are_read(spark):
    text = plan(spark, QUERIES["turn_sentences"](spark, SF_DIR))
    assert re.findall(r"ReadSchema: (\S+)", text)[0] == "struct<conv_id:bigint,turn:bigint,text:string>"
    text = plan(spark, QUERIES["pending_files"](spark, SF_DIR))
    assert "text" not in re.findall(r"ReadSchema: (\S+)", text)[0]


def test_content_is_not_read_for_finished_files(spark, tmp_path):
    """The anti-join comes before any use of the content."""
    from timedtext import schemas
    from timedtext.operators.ledger import pending_files
    from timedtext.sources.files import scan_files

    (tmp_path / "a.srt").write_text("x")
    done = spark.createDataFrame([], schemas.LEDGER)
    names = pending_files(scan_files(spark, str(tmp_path)), done, "en", "fr").select("path")
    assert "content" not in re.findall(r"ReadSchema: (\S+)", plan(spark, names))[0]


def test_files_are_scanned_and_parsed_once(spark, tmp_path):
    from timedtext.sources.files import decode_files, parse_files, scan_files

    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    text = plan(spark, parse_files(decode_files(scan_files(spark, str(tmp_path)))))
    assert text.count("Scan binaryFile") == 2  # once in the tree, once in its details
    assert "Union" not in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["batch_text", "progress"])
def test_lines_are_read_once(no_broadcast, name):
    """All branches have the same aggregate of the lines below them, whose exchange is reused."""
    key = "spark.sql.adaptive.enabled"
    no_broadcast.conf.set(key, "false")
    try:
        text = plan(no_broadcast, QUERIES[name](no_broadcast, SF_DIR))
    finally:
        no_broadcast.conf.set(key, "true")
    assert len(re.findall(r"ReadSchema: (\S+)", text)) == 1
    assert "ReusedExchange" in text


def test_cues_of_a_translation_are_shuffled_once(no_broadcast):
    """Sentences and the sums of full blocks read one shuffle of the cues, pieces meet their cues in
    the shuffle that puts them together, and rows are sorted by text before language."""
    key = "spark.sql.adaptive.enabled"
    no_broadcast.conf.set(key, "false")
    try:
        text = plan(no_broadcast, QUERIES["translate_split_lossless"](no_broadcast, SF_DIR))
    finally:
        no_broadcast.conf.set(key, "true")
    assert "ReusedExchange" in text
    assert not re.findall(r"hashpartitioning\(file_id#\d+L?, cue#\d+L?, src_lang", text)
    assert not re.findall(r"hashpartitioning\(src_lang", text)
