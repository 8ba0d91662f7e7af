"""Removal of repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import pytest

from timedtext.llm import suffix_dedup
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    seen = set()
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame, **options):
    out = suffix_dedup.remove_repeats(frame, keep_bytes=False, **options)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed):
    """Texts that share passages with different neighbours, overlaps, runs and near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)] + ["ab" * 150, "x" * 250]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(text(rng.randrange(0, 40)))
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts.append(p[a : len(p) - rng.randrange(0, 40)])
        rows.append((i * 3, "".join(parts)))
    rows += [(500 + i, rows[i][1][: 90 + i]) for i in range(30)]
    return rows


@pytest.mark.parametrize("batches", [1, 5])
def test_passages(spark, batches):
    rows = corpus(batches)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(frame, batches=batches) == brute(rows)


def test_large_groups_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    rows = corpus(11)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(frame) == brute(rows)


def test_small_cases(spark):
    rows = [
        (3, None), (4, ""), (5, "short"), (6, "y" * 99), (7, "y" * 100), (8, "y" * 101), (None, "z" * 120),
        (9, "z" * 120), (10, "ü" * 700_000), (2, "k" * 130),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, z int")
    want = brute(rows[:8] + rows[9:])
    got = found(frame)
    assert [r for r in got if r[0] != 10] == want
    # a string that starts at the second byte of a letter repeats as well; two first starts stay
    assert [r[1:4] for r in got if r[0] == 10] == [(1_400_000, 1_399_998, 1)]


def test_repeated_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(1, text), (1, text), (2, text)]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [r[:4] for r in got] == [(1, 300, 0, 0), (1, 300, 0, 0), (2, 300, 300, 1)]


def test_many_texts_of_one_id(spark):
    """Texts of one id, and texts without an id, are numbered apart, however their hashes fall."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    rows = [
        (rng.choice([None, None, 5, 7, 100 + i]), "".join(rng.choices("ijk ", k=rng.randrange(90))) + passage[rng.randrange(150) :])
        for i in range(900)
    ]
    rows += rows[:40] + [(None, None), (5, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    text = F.coalesce("text", F.lit(""))
    keyed = frame.select("doc_id", "text", F.xxhash64(text), F.xxhash64(F.lit("tie"), text)).collect()
    ordered = sorted(keyed, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
    once, again, before = [], [], None
    for r in ordered:  # a repeated row is no copy of itself, and gets the same result
        (again if before == tuple(r) else once).append((r[0], r[1]))
        before = tuple(r)
    got = found(frame)
    for row in brute(once):
        got.remove(row)
    assert len(got) == len(again) and set(got) <= set(brute(once))


def test_levels_merge_in_the_query(spark, monkeypatch):
    ranks = []
    insert = suffix_dedup.SuffixLevels._insert

    def noted(self, level):
        insert(self, level)
        ranks.append(sorted(self.levels))

    monkeypatch.setattr(suffix_dedup.SuffixLevels, "_insert", noted)
    rows = corpus(3)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
    assert ranks == [[0], [1], [0, 1]]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)
