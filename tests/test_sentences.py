import pytest
from helpers import (
    cue_table,
    plain_alignment,
    plain_sentences,
    random_contents,
)

from timedtext.operators import align
from timedtext.operators import sentences as sen

FILES = {f"f{i}": random_contents(i) for i in range(30)} | {
    "one": ["Hello. World."],
    "blank": [" ", "\n"],
    "tail": ["Yes.", "No  ", "   "],
    "short": ["a", "", "", "b.", "", "c", ".", "", "d."],
    "end": ["Done. "],
}


@pytest.mark.parametrize("block_rows", [4, 7, 16384])
@pytest.mark.parametrize("profile", ["v1", "v0"])
def test_sentences_of_cues(spark, block_rows, profile):
    """Blocks of a few cues give the same as splitting the whole text."""
    rows = sen.sentences(cue_table(spark, FILES), profile, block_rows).collect()
    for name, contents in FILES.items():
        mine = sorted((r for r in rows if r.file_id == name), key=lambda r: r.sen)
        expected = plain_sentences(contents, profile)
        assert [r.sentence for r in mine] == expected, name
        at = 0
        for number, r in enumerate(mine, 1):
            assert (r.sen, r.sen_start, r.sen_end) == (number, at, at + len(r.sentence) + 1)
            at = r.sen_end


@pytest.mark.parametrize("dense", [True, False])
def test_files_shorter_than_a_block_and_others(spark, dense):
    """Files of up to three blocks of four cues, also such that fill their last block."""
    files = {f"f{n}": random_contents(n, n) for n in range(1, 14)} | {f"g{n}": ["a."] * n for n in range(1, 10)}
    rows = sen.sentences(cue_table(spark, files), block_rows=4, dense=dense).collect()
    found = {name: [r.sentence for r in sorted(rows, key=lambda r: r.sen) if r.file_id == name] for name in files}
    assert found == {name: plain_sentences(contents) for name, contents in files.items()}


@pytest.mark.parametrize("block_rows", [4, 16384])
def test_alignment_of_cues(spark, block_rows):
    rows = align.align_cues(cue_table(spark, FILES), block_rows=block_rows).collect()
    assert len(rows) == sum(map(len, FILES.values()))
    for name, contents in FILES.items():
        mine = {r.cue: (r.sen, r.rel) if r.status == "aligned" else None for r in rows if r.file_id == name}
        assert mine == plain_alignment(contents), name


@pytest.mark.parametrize("block_chars", [3, 50, 65536])
def test_alignment_of_offsets(spark, block_chars):
    cues = cue_table(spark, FILES)
    ends = sen.cue_offsets(cues, 5)
    rows = align.align_offsets(ends, sen.sentences(cues), block_chars)
    direct = align.align_cues(cues).select("file_id", "sen", "cue", "rel", "status")
    assert rows.exceptAll(direct).isEmpty() and direct.exceptAll(rows).isEmpty()


def test_alignment_of_given_offsets(spark):
    ends = spark.createDataFrame(
        [("a", 1, 10), ("b", 1, 5), ("b", 2, 10), ("b", 3, 20), ("b", 4, 25), ("b", 5, 31)],
        "file_id string, cue bigint, cue_end bigint",
    )
    stops = spark.createDataFrame(
        [("a", 1, 0, 15), ("b", 1, 0, 12), ("b", 2, 12, 30)],
        "file_id string, sen bigint, sen_start bigint, sen_end bigint",
    )
    rows = align.align_offsets(ends, stops).orderBy("file_id", "cue").collect()
    assert [(r.sen, r.rel) for r in rows] == [(1, 10), (1, 5), (1, 10), (2, 8), (2, 13), (None, None)]
    assert rows[-1].status == "unaligned"
    assert align.align_offsets(ends.limit(0), stops).isEmpty()


def test_text_and_offsets(spark):
    cues = cue_table(spark, FILES)
    for rows in (2, 16384):
        texts = {r.file_id: r.plain_text for r in sen.document_text(cues, block_rows=rows).collect()}
        old = {r.file_id: r.plain_text for r in sen.document_text(cues, "v0", rows).collect()}
        for name, contents in FILES.items():
            joined = " ".join(c.replace("\n", " ") for c in contents)
            assert texts[name] == joined.rstrip() and old[name] == joined
    ends = sen.cue_offsets(cues, 3).where("file_id = 'short'").orderBy("cue").collect()
    assert [r.cue_end for r in ends] == [2, 3, 4, 7, 8, 10, 12, 13, 16]


def test_sentence_offsets_of_texts(spark):
    texts = spark.createDataFrame([(1, "One. Two. Three."), (2, "")], "file_id bigint, text string")
    rows = sen.sentence_offsets(sen.text_sentences(texts), block_rows=2).orderBy("sen").collect()
    assert [(r.sen_start, r.sen_end) for r in rows] == [(0, 5), (5, 10), (10, 17)]


def test_audit(spark):
    cues = cue_table(spark, {"one": ["Hello. World."], "tail": ["Yes.", "No  ", "   "]})
    rows = {r.file_id: r for r in align.alignment_audit(cues).collect()}
    one, tail = rows["one"], rows["tail"]
    assert (one.sentences, one.sentences_without_cue, one.unaligned_cues) == (2, 1, 0)
    assert (tail.sentences, tail.single_cue_sentences, tail.unaligned_cues) == (2, 1, 2)


def test_sentence_without_cue_is_in_the_table(spark):
    rows = sen.sentence_cues(cue_table(spark, {"one": ["Hello. World."]})).orderBy("sen").collect()
    assert rows[0].ends == [] and rows[0].first_cue == 1
    assert [(e.cue, e.rel) for e in rows[1].ends] == [(1, 7)]
