"""The number of batches of a stream does not grow with its files."""

import os

from helpers import OVEN, cue_table

from timedtext import schemas
from timedtext.operators import compose
from timedtext.plans.translate import Translation, read_ledger
from timedtext.sources.files import write_named_files
from timedtext.streaming import files as stream


def test_batches_are_a_share_of_the_files(spark, tmp_path, monkeypatch):
    text = compose.compose_srt(cue_table(spark, {"a": OVEN})).first().text
    names = [f"f{n}.srt" for n in range(18)] + ["other.txt"]
    rows = spark.createDataFrame([(name, text) for name in names], "path string, content string")
    write_named_files(rows, str(tmp_path / "in"))
    monkeypatch.setattr(stream, "LEAST_FILES", 2)
    source = str(tmp_path / "in")
    assert stream.batch_size(spark, source) == 5
    known = spark.createDataFrame([], schemas.MEMORY)
    job = Translation("en", "es", str(tmp_path / "out"), both=False, sink="files")
    ledger = str(tmp_path / "ledger")
    stream.translate_stream(spark, source, known, job, ledger, str(tmp_path / "stream")).awaitTermination()
    assert read_ledger(spark, ledger).count() == 18
    batches = [d for folder, dirs, _ in os.walk(ledger) for d in dirs if d.startswith("batch=")]
    assert len(batches) == 4


def test_later_batches_find_the_sink(spark, tmp_path, monkeypatch):
    """A sink is looked up in the active session, which from the second batch on was the caller's."""
    session, pending = spark.newSession(), stream.pending_files
    text = compose.compose_srt(cue_table(session, {"a": OVEN})).first().text
    rows = session.createDataFrame([(f"f{n}.srt", text) for n in range(4)], "path string, content string")
    write_named_files(rows, str(tmp_path / "in"))

    def with_the_caller(*args):
        known.sparkSession.createDataFrame([], "n int")
        return pending(*args)

    known = session.createDataFrame([], schemas.MEMORY)
    monkeypatch.setattr(stream, "pending_files", with_the_caller)
    job, ledger = Translation("en", "es", str(tmp_path / "out")), str(tmp_path / "ledger")
    options = {"files_per_batch": 2, "hook": lambda text, src, tgt: text.upper()}
    stream.translate_stream(
        session, str(tmp_path / "in"), known, job, ledger, str(tmp_path / "stream"), **options
    ).awaitTermination()
    assert read_ledger(session, ledger).where("status = 'success'").count() == 4
    assert len([name for name in os.listdir(tmp_path / "out") if name.startswith("output=")]) == 4
