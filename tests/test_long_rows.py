"""Cuts of long sentences: the same as of short ones, in time proportional to the text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from timedtext.functions import text as tx
from timedtext.operators import project


@pytest.fixture()
def rows(spark):
    rng = random.Random(12)
    made = []
    for i in range(60):
        letters = rng.choice(["ab ", "ab", " ", "ab  c,，"])
        text = "".join(rng.choices(letters, k=rng.randrange(0, 700)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(0, 300)))
        words, at = [], 0
        while at < len(text):
            size = rng.randrange(1, 5)
            words.append(text[at : at + size] if rng.random() < 0.8 else "，")
            at += size
        made.append((i, text, cuts, words))
    return spark.createDataFrame(made, "i int, text string, cuts array<int>, words array<string>").cache()


def nearest_space(text, cuts):
    """Behind the space with the smallest distance to the cut; the left one of two."""
    spaces = [i + 1 for i, c in enumerate(text) if c == " "]
    return [min(spaces, key=lambda p: (abs(p - 1 - c), p)) if spaces else c for c in cuts]


def word_ends(words, cuts):
    out = []
    for cut in cuts:
        end = 0
        for k, word in enumerate(words):
            end += len(word)
            if end >= cut:
                end += words[k + 1 : k + 2] == ["，"]
                break
        out.append(end)
    return out


@pytest.mark.parametrize("many", [-1, 10_000])
def test_spaces(rows, monkeypatch, many):
    monkeypatch.setattr(tx, "MANY_CUTS", many)
    monkeypatch.setattr(tx, "FOLD_BLOCK", 7)
    for r in rows.select("text", "cuts", tx.snap_to_space(F.col("text"), F.col("cuts")).alias("got")).collect():
        assert r.got == nearest_space(r.text, r.cuts)


def test_words(rows, monkeypatch):
    monkeypatch.setattr(tx, "FOLD_BLOCK", 7)
    for r in rows.select("words", "cuts", tx.snap_to_word(F.col("words"), F.col("cuts")).alias("got")).collect():
        assert r.got == word_ends(r.words, r.cuts)


def test_running(spark):
    frame = spark.range(1).select(
        tx.running(F.sequence(F.lit(1), F.lit(1000)), F.lit(0), lambda a, b: a + b).alias("sums"),
        tx.running(F.array().cast("array<int>"), F.lit(0), lambda a, b: a + b).alias("none"),
    )
    row = frame.first()
    assert row.sums == [n * (n + 1) // 2 for n in range(1, 1001)] and row.none == []


def long_sentence(spark, cues):
    cue = F.struct((F.col("id") + 1).alias("cue"), ((F.col("id") + 1) * 40).alias("rel"))
    ends = F.sort_array(F.collect_list(cue))
    return (
        spark.range(cues)
        .agg(ends.alias("ends"), F.repeat(F.lit("some words without an end "), cues).alias("translated"))
        .select(
            F.lit("f").alias("file_id"), F.lit(1).alias("sen"), F.lit(1).alias("first_cue"), F.lit(True).alias("kept"),
            "translated", "ends", F.col("translated").alias("sentence"),
            F.lit(0).alias("sen_start"), F.length("translated").alias("sen_end"),
        )
    )


@pytest.mark.parametrize("space", [False, True])
def test_time_follows_the_text(spark, tmp_path, space):
    took = []
    for cues in (8000, 16000):
        long_sentence(spark, cues).write.parquet(path := str(tmp_path / f"{space}-{cues}"))
        runs = []
        for _ in range(3):
            begin = time.time()
            rows = project.project_translation(spark.read.parquet(path), space=space)
            assert rows.agg(F.sum(F.length("piece"))).first()[0] == 26 * cues
            runs.append(time.time() - begin)
        took.append(min(runs))
    assert took[1] <= 2.5 * took[0] + 1
