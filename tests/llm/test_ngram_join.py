"""The exact join against all pairs of small corpora."""

import random

import numpy as np
import pytest
from brute import WORD, lower

from timedtext.llm import ngram_join
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = WORD.findall(lower(text))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 90 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None and s else i) for i, s in sets), key=repr)


def found(frame, **settings):
    return sorted((tuple(r) for r in ngram_join.jaccard_components(frame, **settings).collect()), key=repr)


def edited(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(3)
    return " ".join(words)


def corpus(seed):
    """Groups of copies with few and many edits, chains of versions, and texts of few words."""
    rng = random.Random(seed)
    texts = []
    for size in (12, 60, 150, 150, 400):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(1 + size // 20)) for _ in range(30)]
        version = " ".join(base)
        for _ in range(15):
            version = edited(rng, version.split(), 1 + size // 90)
            texts.append(version)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("settings", [{}, {"hot": 2}, {"hot": 4, "block": 8}])
def test_groups(spark, settings):
    rows = corpus(3)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, class int, prefix string")
    assert found(frame, **settings) == brute(rows)


def test_small_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A\tb"), (6, "a b c"), (7, "x" * 300_000), (12, "a"),
        (8, "one two three four"), (8, "one two three four"), (9, "ONE two three four"), (None, "one two three four"),
        (10, "Éa b c"), (11, "éa b c"), (13, "word " * 50_000), (14, "word word word"), (8, "a b"), (8, None),
    ]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_blocks_are_skipped_without_loss():
    rng = np.random.default_rng(1)
    m = 3000
    n = rng.integers(50, 400, m)
    position = (rng.random(m) * n * 0.1).astype(np.int64)
    root, group = rng.integers(0, 40, m), rng.integers(0, 3, m)
    entries = ngram_join.Entries(group, n, position, root, np.arange(m))
    skipped = []
    pairs = {tuple(sorted(p)) for x, y in entries.joined(entries, skipped) for p in zip(x, y, strict=True)}
    expected = set()
    for a in range(m):
        least = ngram_join.need(n[a], n)
        fits = (position[a] <= n[a] - least) & (position <= n - least) & (group == group[a]) & (root != root[a])
        fits &= 10 * np.minimum(n, n[a]) >= 9 * np.maximum(n, n[a])
        expected |= {tuple(sorted((a, int(b)))) for b in np.flatnonzero(fits)}
    assert pairs == expected
    assert sum(skipped) > 0


def test_derived_overlap():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    leader = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for k in range(12):
        own = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        sets.append(np.union1d(leader[: 200 - k], own))
    rows = [(i, j, x, y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j]
    parts = {
        "a": [r[0] for r in rows],
        "b": [r[1] for r in rows],
        "size": [200] * len(rows),
        **{f"own_{s}": [np.setdiff1d(r[k], leader).tobytes() for r in rows] for s, k in (("a", 2), ("b", 3))},
        **{f"lacks_{s}": [np.setdiff1d(leader, r[k]).tobytes() for r in rows] for s, k in (("a", 2), ("b", 3))},
    }
    out = pa.Table.from_batches(ngram_join.derived(iter([pa.RecordBatch.from_pydict(parts)])))
    expected = [(i, j) for i, j, x, y in rows if 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))]
    assert list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)) == expected
    assert 0 < len(expected) < len(rows)
