"""Near duplicates against all pairs of small corpora."""

import random

import numpy as np
import pytest
from brute import near as brute

from timedtext.llm import near_dup
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def found(frame):
    return sorted((tuple(r) for r in near_dup.near_components(frame).collect()), key=repr)


def variants(seed, n, words=60, changes=8):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_small_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A b\tc"), (6, "a b c d"), (7, "x" * 300_000),
        (8, "one two three four five six"), (8, "one two three four five six"), (9, "ONE two three four five six"),
        (None, "one two three four five six"), (10, "Éa b c d e"), (11, "éa b c d e"), (12, "word " * 50_000),
        (13, "word " * 5),
    ]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    texts = [t for s in range(6) for t in variants(s, 40)] + variants(99, 10, 400, 3)
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string, sketch string")) == []


def test_pipeline_form(spark):
    rows = [(2, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (None, "a b c d e f", 3)]
    out = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, kept int"))
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "a b c d e f", 2), (None, "a b c d e f", 3)]


@pytest.mark.parametrize("share", [0.3, 0.6, 0.75, 0.9])
def test_estimate(share):
    rng = np.random.default_rng(3)
    n = 2000
    both = int(share * n)
    sets = []
    for _ in range(20):
        common = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, (n - both) // 2), dtype=np.uint64)
        sets += [np.concatenate([common, own[0]]), np.concatenate([common, own[1]])]
    regs = near_dup.registers(sets)
    x, y = regs[::2], regs[1::2]
    more, less = (x > y).sum(1), (x < y).sum(1)
    size = np.full(20, float(both + (n - both) // 2))
    j = near_dup.likely_similarity(more, less, near_dup.REGISTERS - more - less, size, size)
    assert abs(j.mean() - share) < 0.03


def test_registers_merge():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    union = near_dup.registers([np.union1d(a, b)])
    assert (np.maximum(*near_dup.registers([a, b])) == union).all()
