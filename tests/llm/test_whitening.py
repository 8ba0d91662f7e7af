"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from timedtext.llm import whitening
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """(vec_id, component) rows by plain Python and numpy."""
    kept = [
        (i, [math.floor(256 * float(c)) + 0 for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({tuple(x) for _, x in kept})
    if not fit:
        return []
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    data = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    v = data.T @ data / n
    values, vectors = np.linalg.eigh(v)
    out = []
    for k in range(min(components, len(v))):
        e, u = values[-1 - k], vectors[:, -1 - k]
        if e <= 1e-12 * np.trace(v):
            continue
        for i, x in kept:
            c = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            out.append((i, k + 1, n, deviation, c @ u / math.sqrt(e), e / np.trace(v)))
    return out


def compare(frame, expected):
    found = [tuple(r) for r in frame.collect()]
    assert len(found) == len(expected)

    def key(r):
        return (r[1], r[0] is not None, r[0] or 0, r[3], abs(round(r[4], 6)))

    found, expected = sorted(found, key=key), sorted(expected, key=key)
    signs = {}
    for f, e in zip(found, expected, strict=True):
        assert f[:4] == e[:4]
        assert f[5] == pytest.approx(e[5], rel=1e-9)
        assert f[6] < 1e-9
        assert abs(f[4]) == pytest.approx(abs(e[4]), abs=1e-7)
        if abs(e[4]) > 1e-6:
            signs.setdefault(f[1], set()).add(f[4] * e[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_table(spark):
    vectors = table(spark, SF_DIR, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    compare(whitening.op12_embedding_whitening(spark, SF_DIR), brute(rows))


def test_small_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(12)]
    nan, inf = float("nan"), float("inf")
    rows += [(12, None), (13, [1.0, None, 2.0]), (14, [nan, 0.0, 0.0]), (15, [0.0, -inf, 0.0])]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (16, [-0.0, -0.0, 1e-9]), (17, [3e9, -3e9, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS X", "2 AS n")
    expected = brute([(r[0], r[1]) for r in frame.collect()])
    found = whitening.whiten(frame).collect()
    assert sorted((r[1], r[0] or -1) for r in found) == sorted((r[1], r[0] or -1) for r in expected)
    assert {r.deviation for r in found} == {d if d < 1 << 63 else None for _, _, _, d, _, _ in expected}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert out.collect() == []
    assert out.columns == [f.split()[0] for f in whitening.WHITENED.split(", ")]


def test_few_distinct_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [(r.component, r.n, r.explained) for r in found] == [(1, 2, pytest.approx(1.0))] * 3


def test_lengths_differ(spark):
    with pytest.raises(ValueError, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], "vec_id bigint, embedding array<double>"))


@pytest.mark.parametrize("seed", range(6))
def test_eigenvectors(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 3, 17, 40, 64][seed]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectrum = [np.arange(d, 0, -1.0), np.ones(d), np.repeat([5.0, 1.0], [min(3, d), d - min(3, d)])][seed % 3]
    v = q * spectrum @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 4)
    assert values == pytest.approx(np.sort(spectrum)[::-1][: min(4, d)], rel=1e-13)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ v - values[:, None] * vectors).max() < 1e-12 * values[0]


def test_close_eigenvalues():
    v = np.diag([1.0, 1 + 1e-12, 1 - 1e-13, 0.5, 0.1])
    values, vectors = whitening.leading(v, 4)
    assert values == pytest.approx([1 + 1e-12, 1, 1 - 1e-13, 0.5], rel=1e-15)
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-12
