"""Files read by splits against files read whole."""

import random

import pytest
from helpers import HARBOUR, cue_table

from timedtext.operators import compose
from timedtext.sources import files as fs
from timedtext.sources import lines as ls


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def compare(spark, folder):
    whole = fs.parse_files(fs.decode_files(fs.scan_files(spark, str(folder))))
    parts = ls.parse_large_files(spark, str(folder))
    assert parts.columns == whole.columns
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_odd_files(small_splits, tmp_path):
    times = "00:00:01,000 --> 00:00:02,000"
    files = {
        "a b+c%41.srt": f"1\n{times}\nx\n\n\n2\n{times}\n\ny\n12\n\nz\n",
        "crlf.srt": f"1\r\n{times} X1:3\r\nx\r\n\r\n2\r\n{times}\r\ny",
        "bom.srt": f"﻿1\n{times}\nx",
        "indent.srt": f"\n  \n  7\n{times}\nx\n8\n{times}",
        "front.srt": f"junk\n1\n{times}\nx",
        "none.srt": "just text\n\nand more",
        "empty.srt": "",
        "blank.srt": "\n \n\n",
        "times.srt": "1\n99999999999999999999:00:00,000 --> 00:00:02,000\nx\n",
        "digits.srt": f"1\n{times}\n5\n6\n7\n{times}\n\n\n\n42\n43\n",
        "minus.srt": f"-1\n{times}\né 日本   end\n3\n0:0:0.1-->0:0:0:2note\nt\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "broken.srt").write_bytes(f"1\n{times}\n\xff\n".encode("latin-1"))
    compare(small_splits, tmp_path)


def test_random_files(small_splits, tmp_path):
    rng = random.Random(3)
    bits = ["1", "22", "-3", "00:00:01,000 --> 00:00:02,000", "0:1:2.3 --> 0:1:2.4 n", "text", "", " ", "é x", "9\n00:00:01,000 --> 00:00:02,000"]
    for i in range(20):
        lines = rng.choices(bits, k=rng.randrange(1, 40))
        if i % 4:
            lines = ["1", "00:00:01,000 --> 00:00:02,000", *lines]
        (tmp_path / f"f{i}.srt").write_text("\n".join(lines))
    compare(small_splits, tmp_path)


def test_one_file_in_many_tasks(small_splits, tmp_path):
    cues = [(i * 10, i * 10 + 5, f"cue {i}\nof many") for i in range(250)]
    text = compose.compose_srt(cue_table(small_splits, {"a": cues, "b": HARBOUR})).where("file_id = 'a'").first().text
    (tmp_path / "a.srt").write_text(text)
    lines = ls.scan_lines(small_splits, str(tmp_path))
    assert lines.select("split").distinct().count() > 50
    rows = ls.parse_large_files(small_splits, str(tmp_path)).orderBy("cue").collect()
    assert [(r.cue, r.start_ms, r.end_ms, r.content) for r in rows] == [(i + 1, *c) for i, c in enumerate(cues)]
