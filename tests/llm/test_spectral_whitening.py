"""Whitening against a dense eigensolver and whole-number sums, on rows with nulls, repeats, odd lengths and clashing columns."""

import math
from collections import defaultdict

import numpy as np
import pytest

from changeproof.llm import spectral_whitening as sw

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component string, place string, value string, w0 string"


def vectors(r, n, width):
    base = r.normal(size=(5, width)) * np.array([3, 2, 1.5, 1, 0.7])[:, None]
    return (r.normal(size=(n, 5)) @ base + 0.05 * r.normal(size=(n, width)) + 4).astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    found = [(i, v.tolist()) for i, v in enumerate(vectors(r, 400, 12))]
    odd = [None, [], [None] * 12, [1.0] * 11, [float("nan")] * 12, [1.0] * 11 + [float("inf")], [-1.0] * 11 + [float("-inf")], [0.5] * 11 + [None], [-0.0] * 12]
    return found + found[:40] * 3 + [(1000 + k, v) for k, v in enumerate(odd)] + [(None, found[3][1]), (None, None)]


def sound(rows):
    kept = [(i, v) for i, v in rows if v and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, tuple(math.floor(256 * c) for c in v)) for i, v in kept]


@pytest.mark.parametrize("parts", [1, 4])
def test_whiten(spark, rows, parts):
    got = sw.whiten(spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA).repartition(parts)).collect()
    kept = sound(rows)
    fit = sorted(set(x for _, x in kept))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    assert len(got) == 4 * len(kept)
    mine = defaultdict(list)
    for r in got:
        mine[r.component].append(r)
    for k in range(4):
        # The same sign for all rows: the vector is found again from the rows by its sign alone.
        expected = sorted((i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), float((np.array(x) - np.array(sums) / n) @ columns[:, k] / values[k] ** 0.5)) for i, x in kept)
        found = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in mine[k + 1])
        assert [e[:3] for e in expected] == [f[:3] for f in found]
        sign = np.sign(sum(e[3] * f[3] for e, f in zip(expected, found, strict=True)))
        assert [f[3] * sign for f in found] == pytest.approx([e[3] for e in expected], abs=1e-9)
        assert [r.explained for r in mine[k + 1]] == pytest.approx([values[k] / values.sum()] * len(kept), rel=1e-9)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_counts_are_inertias():
    r = np.random.default_rng(5)
    for width in (1, 2, 3, 8, 40):
        for _ in range(20):
            a = r.normal(size=(width, width))
            a = a + a.T
            if width == 8:
                np.fill_diagonal(a, 0)
            values = np.linalg.eigvalsh(a)
            for shift in (*r.normal(size=4), 0.0, float(values.mean())):
                assert sw.count_above(a, shift) == int((values > shift).sum())


def test_leading_pairs_of_hard_spectra():
    r = np.random.default_rng(6)
    for spectrum in ([5, 5, 5, 5, 1, 0], [9, 9 - 1e-9, 3, 3, 1, 1], [1e8, 1e4, 1, 1e-3, 0, 0], [3, 3, 2, 2, 2, 2], [1e-20, 1e-21, 0, 0, 0, 0], [7, 2, 0, 0, 0, 0], [0] * 6, [1, 1 - 1e-13, 1 - 2e-13, 0.5, 0, 0]):
        q = np.linalg.qr(r.normal(size=(6, 6)))[0]
        a = q @ np.diag(spectrum).astype(float) @ q.T
        a = (a + a.T) / 2
        found = sw.leading(a, 4)
        assert len(found) == min(4, sum(s > 1e-12 * spectrum[0] for s in spectrum))
        for (value, v), s in zip(found, spectrum, strict=False):
            assert value == pytest.approx(s, abs=1e-12 * max(spectrum)) and np.linalg.norm(a @ v - value * v) <= 1e-13 * max(spectrum)
        if found:
            v = np.stack([v for _, v in found])
            assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-12


def test_large_numbers_and_few_dimensions(spark):
    rows = [(i, [1e6 + i, float(i % 3)]) for i in range(30)]
    got = sw.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-4
    x = [[256 * c for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, int(sum((30 * c - s) ** 2 for c, s in zip(v, sums, strict=True)))) for i, v in enumerate(x)}
    big = sw.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in big] == [None, None]


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)] + [(9, None)], "vec_id long, embedding array<float>")
    for got in (sw.whiten(none), sw.whiten(same), sw.whiten(same.where("vec_id = 9"))):
        assert got.count() == 0 and [f.name for f in got.schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
