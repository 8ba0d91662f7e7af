"""What several runs share: claims of outputs, learned memory, ledger snapshots; and cues with
gaps in their numbers."""

import os

import pytest
from helpers import HARBOUR, OVEN, cue_table, plain_alignment, random_contents
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.operators import align, claims, compose, memory, runs
from timedtext.operators import sentences as sen
from timedtext.plans import translate as plans
from timedtext.plans.encode import encode_corpus
from timedtext.plans.translate import Translation, read_ledger, translate_corpus
from timedtext.streaming.files import translate_stream

PAIR = {"src_lang": "en", "tgt_lang": "es"}


def write(spark, folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, cues in files.items():
        text = compose.compose_srt(cue_table(spark, {"x": cues})).first().text
        (folder / name).write_text(text)


def calls(folder):
    """A translator that notes each line it is asked for in a file of its own."""

    def translate(text, src, tgt):
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(text)
        return text.upper()

    return translate


def asked(folder):
    lines = []
    for name in os.listdir(folder) if os.path.exists(folder) else []:
        lines += open(f"{folder}/{name}").read().split("\n")
    return sorted(lines)


@pytest.mark.parametrize("sink", ["files", "parts"])
def test_an_output_stays_with_its_input(spark, tmp_path, sink):
    write(spark, tmp_path / "a", {"x.srt": HARBOUR})
    write(spark, tmp_path / "b", {"x.srt": OVEN, "y.srt": OVEN})
    texts = [r.sentence for r in sen.sentences(cue_table(spark, {"a": HARBOUR, "b": OVEN})).collect()]
    known = spark.createDataFrame([("en", "es", t, t.upper()) for t in texts], schemas.MEMORY)
    job = Translation("en", "es", str(tmp_path / "out"), both=False, sink=sink)
    ledger = str(tmp_path / "ledger")
    translate_corpus(spark, str(tmp_path / "a"), known, job, ledger)
    done = translate_corpus(spark, str(tmp_path / "b"), known, job, ledger)
    rows = {"/".join(r.path.rsplit("/", 2)[1:]): r for r in done.collect()}
    assert {k: r.status for k, r in rows.items()} == {"a/x.srt": "success", "b/x.srt": "error", "b/y.srt": "success"}
    assert rows["b/x.srt"].output is None and "a/x.srt" in rows["b/x.srt"].message
    assert rows["b/x.srt"].progress == 0.0
    written = "".join(
        (folder and open(f"{folder}/{n}").read())
        for folder, _, names in os.walk(tmp_path / "out")
        for n in sorted(names)
        if "x_en" in f"{folder}/{n}" and not n.endswith(".crc") and n != "_SUCCESS"
    )
    assert "FOG HIDES" in written and "OVEN" not in written
    # with another ledger, and again from the owner
    other = translate_corpus(spark, str(tmp_path / "b"), known, job, str(tmp_path / "ledger2"))
    assert sorted(r.status for r in other.collect()) == ["error", "success"]
    again = translate_corpus(spark, str(tmp_path / "a"), known, job, ledger, resume=False)
    assert again.where("path LIKE '%a/x.srt'").first().status == "success"


def test_conversions_keep_their_outputs(spark, tmp_path):
    for folder in ("a", "b"):
        write(spark, tmp_path / folder, {"x.srt": HARBOUR})
    out = str(tmp_path / "out")
    first = encode_corpus(spark, str(tmp_path / "a"), out, ["cp1252"], source="utf-8")
    second = encode_corpus(spark, str(tmp_path / "b"), out, ["cp1252"], source="utf-8")
    again = encode_corpus(spark, str(tmp_path / "a"), out, ["cp1252"], source="utf-8")
    assert [[r.success for r in rows.collect()] for rows in (first, second, again)] == [[True], [False], [True]]


def test_first_claim_counts(spark, tmp_path):
    wanted = spark.createDataFrame([("o", "b"), ("p", "b")], "output string, input string")
    assert {tuple(r) for r in claims.claim_outputs(wanted, str(tmp_path), "one").collect()} == {("o", "b"), ("p", "b")}
    wanted = spark.createDataFrame([("o", "a"), ("q", "a")], "output string, input string")
    for _ in range(2):  # a batch that is done again
        found = {tuple(r) for r in claims.claim_outputs(wanted, str(tmp_path), "two").collect()}
        assert found == {("o", "b"), ("q", "a")}
    assert claims.claim_outputs(wanted.limit(0), str(tmp_path), "three").isEmpty()


def test_the_translator_is_asked_once(spark, tmp_path):
    write(spark, tmp_path / "in", {"a.srt": HARBOUR, "b.srt": OVEN})
    empty = spark.createDataFrame([], schemas.MEMORY)
    job = Translation("en", "es", str(tmp_path / "out"), both=False, sink="files")
    options = {"hook": calls(str(tmp_path / "calls")), "learned_path": str(tmp_path / "learned")}

    def batch(ledger, **more):
        return translate_corpus(spark, str(tmp_path / "in"), empty, job, str(tmp_path / ledger), **options, **more)

    batch("ledger", pattern="a.srt")
    stream = translate_stream(
        spark, str(tmp_path / "in"), empty, job, str(tmp_path / "ledger"), str(tmp_path / "stream"), **options
    )
    stream.awaitTermination()
    done = batch("other", resume=False)
    assert {r.status for r in done.collect()} == {"success"}
    sentences = {"Fog hides the pier.", "A gull lands, looks at us, and steals the bread!", "Nobody laughs."}
    sentences |= {"Who is there?", "Only the oven.", "It hums"}
    assert asked(str(tmp_path / "calls")) == sorted(sentences)
    known = memory.read_learned(spark, str(tmp_path / "learned")).collect()
    assert {r.text: r.translated for r in known} == {s: s.upper() for s in sentences} and len(known) == 6


def test_a_repeated_batch_asks_for_nothing(spark, tmp_path):
    """A batch that fails after the translator was asked, and is done again."""
    write(spark, tmp_path / "in", {"a.srt": OVEN})
    empty = spark.createDataFrame([], schemas.MEMORY)
    job = Translation("en", "es", str(tmp_path / "out"), both=False, sink="files")
    files = plans.scan_files(spark, str(tmp_path / "in"))
    hook, learned = calls(str(tmp_path / "calls")), str(tmp_path / "learned")
    for _ in range(2):
        plans.translate_files(files, empty, job, [str(tmp_path / "in")], hook, learned, "run", 3).collect()
    assert asked(str(tmp_path / "calls")) == ["It hums", "Only the oven.", "Who is there?"]


def test_memory_before_what_is_learned(spark):
    known = spark.createDataFrame([("en", "es", "a", "own")], schemas.MEMORY)
    learned = spark.createDataFrame([("en", "es", "a", "other"), ("en", "es", "b", "more")], schemas.MEMORY)
    rows = memory.joined_memory(known, learned).collect()
    assert sorted((r.text, r.translated) for r in rows) == [("a", "own"), ("b", "more")]


def test_learned_rows_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "MOST_BATCHES", 2)
    path = str(tmp_path / "learned")
    for batch in range(6):
        rows = spark.createDataFrame([("en", "es", "same", f"t{batch}"), ("en", "es", f"b{batch}", "x")], schemas.MEMORY)
        memory.add_learned(rows, path, "en", "es", "run", batch)
        assert len(runs.batches(spark, path, PAIR)) <= 4
    found = {r.text: r.translated for r in memory.read_learned(spark, path).collect()}
    assert found == {"same": "t0"} | {f"b{i}": "x" for i in range(6)}


def test_ledger_snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "LEDGER_BATCHES", 3)
    path, job = str(tmp_path / "ledger"), Translation("en", "es", "out")
    sizes = []
    for batch in range(9):
        names = [(f"f{batch}",), ("always",)]
        status = "success" if batch % 2 else "error"
        rows = spark.createDataFrame(names, "path string").select(
            "path",
            F.lit("en").alias("src_lang"),
            F.lit("es").alias("tgt_lang"),
            F.lit(status).alias("status"),
            F.lit(f"m{batch}").alias("message"),
            F.lit(None).cast("string").alias("output"),
            F.lit(0.0).alias("progress"),
            F.timestamp_seconds(F.lit(1000 + batch)).alias("updated_at"),
        )
        plans.write_ledger(rows, path, job, "run", batch)
        sizes.append(len(runs.batches(spark, path, PAIR)))
    assert max(sizes) <= 5
    found = {r.path: r.message for r in read_ledger(spark, path).collect()}
    assert found == {f"f{i}": f"m{i}" for i in range(9)} | {"always": "m8"}
    plans.write_ledger(read_ledger(spark, path).limit(0), path, Translation("en", "de", "out"), "run")
    assert read_ledger(spark, path).count() == 10
    assert read_ledger(spark, path, without=("run", 8)).where("path = 'f8'").isEmpty()


def gapped(spark, seed):
    """Contents by dense number, and cues with gaps, null contents and cues without a place."""
    contents = {f"f{i}": random_contents(seed + i, 30) for i in range(4)}
    contents = {k: [c if i % 5 else "" for i, c in enumerate(v)] for k, v in contents.items()}
    cues = cue_table(spark, contents).withColumn("content", F.when(F.col("content") != "", F.col("content")))
    cues = cues.withColumn("cue", F.col("cue") * 7 - F.col("cue") % 3)
    lost = spark.createDataFrame(
        [(None, 3, 0, 1, "no file", ""), ("f0", None, 0, 1, "no number", ""), ("f1", None, 0, 1, None, "")], cues.schema
    )
    return contents, cues.unionByName(lost)


@pytest.mark.parametrize("block_rows", [4, 16, 16384])
def test_gaps_and_nulls(spark, block_rows):
    contents, cues = gapped(spark, 40)
    rows = align.align_cues(cues, block_rows=block_rows).collect()
    found = {(r.file_id, r.cue): (r.sen, r.rel) if r.status == "aligned" else None for r in rows if r.status != "unplaced"}
    expected = {
        (k, n * 7 - n % 3): place for k, v in contents.items() for n, place in plain_alignment(v).items()
    }
    assert found == expected
    lost = [(r.file_id, r.cue) for r in rows if r.status == "unplaced"]
    assert sorted(lost, key=repr) == sorted([(None, 3), ("f0", None), ("f1", None)], key=repr)
    ends = {(r.file_id, r.cue): r.cue_end for r in sen.cue_offsets(cues, block_rows).collect()}
    assert ends[None, 3] is None and ends["f0", None] is None
    assert ends["f2", 7 - 1] == len(contents["f2"][0]) + 1
    texts = {r.file_id: r.plain_text for r in sen.document_text(cues, block_rows=block_rows).collect()}
    assert texts == {k: " ".join(c.replace("\n", " ") for c in v).rstrip() for k, v in contents.items()}


def test_repeated_numbers(spark):
    cues = cue_table(spark, {"a": ["One.", "Two", "more. Three."]}).withColumn("cue", F.lit(5).cast("bigint"))
    rows = sen.sentences(cues, block_rows=4).orderBy("sen").collect()
    assert [r.sentence for r in rows] == ["One.", "Two more.", "Three."]
