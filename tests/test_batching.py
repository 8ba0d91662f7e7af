import random

import pytest
from pyspark.sql import functions as F

from timedtext.operators import batching


def line_table(spark, files):
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "file_id string, line_no bigint, line string")


def plain_batches(lines, budget, strict):
    out, total, batch = [], 0, 0
    for at, line in enumerate(lines):
        total += len(line)
        if total > budget:
            total = len(line) if strict else 0
            batch += at > 0
        out.append(batch)
    return out


def batches_of(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.file_id, r.line_no)):
        found.setdefault(r.file_id, []).append(r.batch_no)
    return found


def test_line_that_overflows_does_not_count(spark):
    lines = {"f": ["x" * n for n in (2000, 2000, 100, 3000, 600)]}
    rows = batching.batch_lines(line_table(spark, lines)).collect()
    assert batches_of(rows) == {"f": [0, 1, 1, 1, 2]}
    rows = batching.batch_lines(line_table(spark, lines), strict=True).collect()
    assert batches_of(rows) == {"f": [0, 1, 1, 2, 3]}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_rows", [3, 16384])
def test_against_a_plain_loop(spark, strict, block_rows):
    """Files of many small blocks, over several groups of blocks, give the same batches."""
    rng = random.Random(5)
    files = {
        f"f{k}": ["y" * rng.choice([0, 0, 1, 5, 9, 30, 70]) for _ in range(rng.randint(1, 60))]
        for k in range(12)
    }
    files["long"] = ["z" * rng.choice([0, 3, 8]) for _ in range(3 * 300)]
    files["even"] = ["w" * 10] * 50
    rows = batching.batch_lines(line_table(spark, files), 50, strict, block_rows).collect()
    expected = {name: plain_batches(lines, 50, strict) for name, lines in files.items()}
    assert batches_of(rows) == expected


def test_batch_text_and_progress(spark):
    lines = line_table(spark, {"f": ["aaaa", "bb", "cccc", "d"], "g": ["", " "]})
    for block_rows in (2, 100):
        batches = batching.batch_text(lines, 5, block_rows=block_rows)
        rows = batches.where("file_id = 'f'").orderBy("batch_no").collect()
        found = [(r.first_line, r.last_line, r.text) for r in rows]
        assert found == [(1, 1, "aaaa"), (2, 4, "bb\ncccc\nd")]
        done = batching.progress(batches).orderBy("batch_no").collect()
        assert [r.file_id for r in done] == ["f"] * len(rows)  # a blank batch reports nothing
        assert done[-1].progress == 100.0 and done[0].progress == 25.0


def tagged(batches):
    return batches.withColumn("src_lang", F.lit("en")).withColumn("tgt_lang", F.lit("es"))


def test_translate_with(spark):
    def hook(text, src, tgt):
        if "fail" in text:
            raise RuntimeError("limit")
        return text.upper() if "short" not in text else "ONLY"

    lines = line_table(spark, {"ok": ["a", "", "b"], "bad": ["fail"], "few": ["short", "x"], "none": [" "]})
    rows = batching.translate_with(tagged(batching.batch_text(lines)), hook)
    found = {(r.file_id, r.line_no): r for r in rows.collect()}
    assert [found["ok", n].translated for n in (1, 2, 3)] == ["A", "", "B"]
    assert [found["few", n].translated for n in (1, 2)] == ["ONLY", ""]
    assert found["none", 1].translated == ""
    bad = found["bad", 1]
    assert (bad.translated, bad.status, bad.message) == (None, "error", "Translation error: limit")


def test_translate_misses_extends_the_memory(spark):
    misses = spark.createDataFrame(
        [("en", "es", f"line {n}") for n in range(50)] + [("fr", "es", "line 1")],
        "src_lang string, tgt_lang string, text string",
    )
    rows = batching.translate_misses(misses, lambda t, s, g: t.replace("line", s + g), 3, 40).collect()
    assert len(rows) == 51
    assert all(r.translated == r.text.replace("line", r.src_lang + r.tgt_lang) for r in rows)


def test_few_rows_of_an_arrow_batch_become_python_at_once():
    import pyarrow as pa

    whole = pa.RecordBatch.from_pydict({"n": list(range(600))})
    parts = list(batching.in_slices(iter([whole, whole.slice(0, 0)]), batching.REQUEST_SLICE))
    assert [p.num_rows for p in parts] == [256, 256, 88]
    assert [n for p in parts for n in p["n"].to_pylist()] == list(range(600))
