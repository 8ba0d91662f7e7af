import datetime
import os

import pytest
from helpers import HARBOUR, OVEN, cue_table

from timedtext import schemas
from timedtext.operators import compose, ledger, memory
from timedtext.operators.encoding import COMPAT
from timedtext.operators import sentences as sen
from timedtext.plans.encode import encode_corpus
from timedtext.plans.translate import (
    Translation,
    read_ledger,
    translate_corpus,
    translate_cues,
    translate_naive,
    translate_split,
)
from timedtext.session import shared_dir
from timedtext.streaming.files import translate_stream
from pyspark.sql import functions as F


def with_languages(cues, src="en", tgt="es"):
    return cues.withColumn("src_lang", F.lit(src)).withColumn("tgt_lang", F.lit(tgt))


def upper_memory(spark, texts, src="en", tgt="es"):
    rows = [(src, tgt, t, t.upper()) for t in texts]
    return spark.createDataFrame(rows, schemas.MEMORY)


def texts_of(rows):
    return [r.content for r in sorted(rows, key=lambda r: (r.file_id, r.cue))]


def test_split_translation(spark):
    cues = with_languages(cue_table(spark, {"a": HARBOUR}))
    known = upper_memory(
        spark,
        [r.sentence for r in sen.sentences(cues).collect()],
    )
    rows = translate_split(cues, known, both=False).collect()
    assert texts_of(rows) == [
        "FOG HIDES THE PIER.",
        "A GULL LANDS, LOOKS AT US, AND STEALS THE BREAD!",  # no later cue ends in it
        "NOBODY ",
        "LAUGHS.",
    ]
    compat = translate_split(cues, known, both=True, mode="compat").collect()
    assert texts_of(compat)[0] == "FOG HIDES THE PIER.\nFog hides the pier."
    assert {r.status for r in rows} == {"aligned"}


def test_split_translation_into_chinese_uses_the_words(spark):
    cues = with_languages(cue_table(spark, {"a": ["one two", "three four."]}), tgt="zh-CN")
    known = spark.createDataFrame(
        [("en", "zh-CN", "one two three four.", "我们，喜欢音乐。", ["我们，喜欢", "音乐", "。"])],
        "src_lang string, tgt_lang string, text string, translated string, words array<string>",
    )
    assert texts_of(translate_split(cues, known, both=False).collect()) == ["我们，喜欢", "音乐。"]
    plain = translate_split(cues, known.drop("words"), both=False).collect()
    assert texts_of(plain) == ["我们，", "喜欢音乐。"]


def test_unaligned_cues_stay(spark):
    cues = with_languages(cue_table(spark, {"a": ["Yes.", "No  ", "   "]}))
    known = upper_memory(spark, ["Yes.", "No"])
    rows = sorted(translate_split(cues, known, both=False).collect(), key=lambda r: r.cue)
    assert [(r.status, r.content) for r in rows] == [
        ("aligned", "YES."),
        ("aligned", "NO"),  # no cue ends in the sentence; it stays where it begins
        ("unaligned", ""),
    ]
    rows = sorted(translate_split(cues, known, False, "compat").collect(), key=lambda r: r.cue)
    assert [r.status for r in rows] == ["aligned", "unaligned", "unaligned"]


def test_naive_translation(spark):
    cues = with_languages(cue_table(spark, {"b": OVEN}))
    known = upper_memory(spark, ["Who isthere?"])
    assert texts_of(translate_naive(cues, known).collect()) == [
        "WHO ISTHERE?\nWho is there?",
        "\nOnly the oven. It hums",
    ]
    assert texts_of(translate_cues(cues, known, "naive", False, on_miss="source").collect())[1] == "Only the oven. It hums"


def write_files(directory, files):
    os.makedirs(directory, exist_ok=True)
    for name, data in files.items():
        (directory / name).write_bytes(data)


def srt(spark, cues):
    return compose.compose_srt(cue_table(spark, {"x": cues})).first().text.encode()


def read(directory, name):
    return (directory / name).read_text(encoding="utf-8")


@pytest.fixture
def corpus(spark, tmp_path):
    files = {"a.srt": srt(spark, HARBOUR), "b.srt": srt(spark, OVEN), "bad.srt": b"\xff\xfe\x00", "text.srt": b"no cues"}
    write_files(tmp_path / "in", files)
    texts = [r.sentence for r in sen.sentences(cue_table(spark, {"a": HARBOUR, "b": OVEN})).collect()]
    return tmp_path, upper_memory(spark, texts)


def test_corpus_is_resumed(spark, corpus):
    root, known = corpus
    job = Translation("en", "es", str(root / "out"), both=False, sink="files")
    done = translate_corpus(spark, str(root / "in"), known, job, str(root / "ledger"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "a.srt": "success", "b.srt": "success", "bad.srt": "error", "text.srt": "error"
    }
    assert rows["a.srt"].output == f"{root}/out/a_en_es_only.srt" and rows["a.srt"].progress == 100.0
    assert rows["bad.srt"].message.startswith("Failed to decode") and rows["bad.srt"].output is None
    assert sorted(os.listdir(root / "out")) == ["a_en_es_only.srt", "b_en_es_only.srt"]
    assert "FOG HIDES THE PIER." in read(root / "out", "a_en_es_only.srt")

    # a finished file is not done again, a repaired one is
    (root / "out" / "a_en_es_only.srt").write_text("kept")
    (root / "in" / "bad.srt").write_bytes(srt(spark, OVEN))
    done = translate_corpus(spark, str(root / "in"), known, job, str(root / "ledger"))
    status = ledger.status_summary(done).first()
    assert (status.success, status.error, status.total) == (3, 1, 4)
    assert read(root / "out", "a_en_es_only.srt") == "kept"
    assert (root / "out" / "bad_en_es_only.srt").exists()


def test_naive_corpus_in_parts(spark, corpus):
    root, _ = corpus
    known = upper_memory(spark, ["Who isthere?"])
    job = Translation("en", "es", str(root / "out"), mode="naive", sink="parts", on_miss="source")
    done = translate_corpus(spark, str(root / "in"), known, job, str(root / "ledger"), pattern="b.srt")
    assert done.count() == 1
    folder = root / "out" / "output=b_en_es_both.srt"
    text = "".join(read(folder, p) for p in sorted(os.listdir(folder)) if p.startswith("part"))
    assert text.startswith("1\n00:00:00,000 --> 00:00:00,800\nWHO ISTHERE?\nWho is there?\n\n2\n")


def test_stream_takes_new_files_only(spark, corpus):
    root, known = corpus
    job = Translation("en", "es", str(root / "out"), both=False, sink="files")

    def run():
        query = translate_stream(
            spark, str(root / "in"), known, job, str(root / "ledger"), str(root / "stream"), files_per_batch=3
        )
        query.awaitTermination()
        return read_ledger(spark, str(root / "ledger"))

    assert run().count() == 4
    (root / "out" / "a_en_es_only.srt").write_text("kept")
    write_files(root / "in", {"c.srt": srt(spark, HARBOUR)})
    done = run()
    assert ledger.status_summary(done).first().success == 3
    assert read(root / "out", "a_en_es_only.srt") == "kept"
    assert "FOG HIDES" in read(root / "out", "c_en_es_only.srt")


def test_encode_corpus(spark, tmp_path):
    text = srt(spark, [(0, 1000, "Café " * 30)])
    write_files(tmp_path / "in", {"sample.srt": text, "tiny.srt": b"abc", "skip.txt": text})
    job = (spark, str(tmp_path / "in"), str(tmp_path / "out"), ["utf-8", "utf-8-sig", "cp1252"])
    done = encode_corpus(*job, **COMPAT)
    rows = {(r.path.rsplit("/", 1)[1], r.target): r for r in done.collect()}
    assert rows["sample.srt", "utf-8"].skipped and rows["sample.srt", "cp1252"].success
    assert not rows["tiny.srt", "cp1252"].success  # too short to detect
    assert sorted(os.listdir(tmp_path / "out")) == ["sample-cp1252.srt", "sample-utf-8-sig.srt"]
    assert (tmp_path / "out" / "sample-cp1252.srt").read_bytes() == text.decode().encode("cp1252")
    totals = {r.target: (r.converted, r.attempted) for r in ledger.conversion_summary(done).collect()}
    assert totals == {"utf-8": (1, 2), "utf-8-sig": (1, 2), "cp1252": (1, 2)}
    assert encode_corpus(*job).where("not success").isEmpty()  # by default of any length
    assert (tmp_path / "out" / "tiny-cp1252.srt").read_bytes() == b"abc"


def test_outputs_that_meet_fail(spark, tmp_path):
    write_files(tmp_path / "in", {"a.srt": b"one", "a-utf-8.srt": b"two"})
    done = encode_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["cp1252"])
    assert [r.success for r in done.collect()] == [False, False]
    with pytest.raises(ValueError):
        encode_corpus(spark, str(tmp_path / "in"), "hdfs://nn/out", ["cp1252"])


def test_no_content_is_shuffled_for_what_is_refused(spark, tmp_path, monkeypatch):
    """The conversions of all files met those that may not be written in a shuffle."""
    from timedtext.plans import encode

    written, write = [], encode.write_named_files
    monkeypatch.setattr(encode, "write_named_files", lambda rows, folder: (written.append(rows), write(rows, folder)))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    for at, least in enumerate(["4k", "-1"]):
        source, out = tmp_path / f"in{at}", tmp_path / f"out{at}"
        noise = {f"n{i}.srt": os.urandom(2000).hex().encode() for i in range(8)}
        odd = {"a.srt": "Café €".encode(), "b.srt": b"\xff", "a-utf-8.srt": b"two", "c.srt": b"y"}
        write_files(source, odd | noise)
        write_files(tmp_path / f"old{at}", {"c.srt": b"old"})
        encode_corpus(spark, str(tmp_path / f"old{at}"), str(out), ["latin-1"], source="utf-8")
        spark.conf.set(key, least)
        try:
            names = ["utf-8", "cp1252", "latin-1", "nope"]
            rows = encode_corpus(spark, str(source), str(out), names, source="utf-8").collect()
        finally:
            spark.conf.set(key, before)
        rows = {(r.path.rsplit("/", 1)[1], r.target): r for r in rows}
        assert len(rows) == 4 * 12
        assert {k for k, r in rows.items() if r.skipped} == {(n, "utf-8") for n in odd | noise}
        bad = {(n, t) for n in ("a.srt", "a-utf-8.srt", "b.srt") for t in ("cp1252", "latin-1")}
        bad |= {("c.srt", "latin-1")} | {(n, "nope") for n in odd | noise}
        assert {k for k, r in rows.items() if not r.success} == bad
        good = {r.output_path: n for (n, t), r in rows.items() if r.success and not r.skipped}
        assert set(os.listdir(out)) == set(good) | {"c-latin-1.srt"}
        assert (out / "c-latin-1.srt").read_bytes() == b"old"
        assert all((out / path).read_bytes() == (odd | noise)[name] for path, name in good.items())
    plan = written[1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_ledger(spark):
    def rows(*values):
        filled = [(p, "en", tgt, s, None, None, 0.0, datetime.datetime(2024, 1, day)) for p, tgt, s, day in values]
        return spark.createDataFrame(filled, schemas.LEDGER)

    old = rows(("a", "fr", "error", 1), ("b", "fr", "success", 3), ("c", "fr", "rate_limited", 1), ("a", "de", "success", 1))
    new = rows(("a", "fr", "success", 2), ("b", "fr", "error", 2), ("c", "fr", "error", 1))
    merged = ledger.ledger_merge(old, new)
    found = {(r.path, r.tgt_lang): r.status for r in merged.collect()}
    assert found == {("a", "fr"): "success", ("b", "fr"): "success", ("c", "fr"): "error", ("a", "de"): "success"}
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    assert {r.path for r in ledger.pending_files(files, merged, "en", "fr").collect()} == {"c", "d"}
    summary = {r.tgt_lang: r for r in ledger.status_summary(old).collect()}["fr"]
    assert (summary.success, summary.rate_limited, summary.error, summary.total) == (1, 1, 1, 3)


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_memory_grows_by_the_hook(spark):
    from timedtext.operators.batching import translate_misses

    cues = with_languages(cue_table(spark, {"b": OVEN}))
    rows = sen.sentence_cues(cues, keep=("src_lang", "tgt_lang")).where("kept")
    known = upper_memory(spark, ["Only the oven."])
    misses = memory.memory_misses(rows, known, "sentence")
    more = known.unionByName(translate_misses(misses, lambda t, s, g: t.lower(), 2))
    assert memory.memory_misses(rows, more, "sentence").isEmpty()
