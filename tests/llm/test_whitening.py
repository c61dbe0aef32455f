"""Whitening against eigenvectors of whole-number covariances in one place."""

from __future__ import annotations

import math

import numpy as np
import pytest

from threadloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n long, whitened string"


def by_hand(vectors):
    """n, exact deviations, falling eigenvalues, eigenvectors, x - mean."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    far = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, far, values[::-1], axes[:, ::-1], centred


def check(spark, rows, kept, components=32):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(4)
    got = [r.asDict() for r in W.by_component(W.whiten(df, components=components)).collect()]
    n, far, values, axes, centred = by_hand([v for _, v in kept])
    width = min(components, len(values))
    assert len(got) == len(kept) * width and {r["n"] for r in got} == {n}
    key = lambda i: (i is not None, i or 0)
    held = {}
    for r in got:
        held.setdefault(r["vec_id"], []).append(r)
    for (i, _), d, c in sorted(zip(kept, far, centred, strict=True), key=lambda t: key(t[0][0])):
        assert all(r["deviation"] == d for r in held[i])
        for r in held[i]:
            k = r["component"] - 1
            assert abs(r["explained"] - values[k] / values.sum()) <= 1e-9
            if r["whitened"] is not None:
                want = c @ axes[:, k] / math.sqrt(values[k])
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-7
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    return got


def test_whitened(spark):
    gen = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(gen.normal(size=(300, 7)) * [9, 7, 5, 4, 3, 2, 1])]
    odd = [(900, None), (901, [1.0] * 6 + [None]), (902, [1.0] * 6 + [float("nan")]), (903, [float("inf")] + [1.0] * 6), (904, []), (905, [1.0, 2.0])]
    check(spark, rows + odd, rows)
    check(spark, rows + odd, rows, components=3)


def test_one_sign_for_all_rows_and_unit_variance(spark):
    gen = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(gen.normal(size=(200, 4)) @ np.diag([8, 4, 2, 1]))]
    got = check(spark, rows, rows)
    table = np.zeros((200, 4))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(table.T, bias=True) - np.eye(4)).max() < 1e-9


def test_flat_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = W.by_component(W.whiten(df)).collect()
    assert len(got) == 6 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    line = spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(9)], "vec_id long, embedding array<float>")
    got = W.by_component(W.whiten(line)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and all(r.identity_error < 1e-12 for r in got)
    assert W.whiten(line.limit(0)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(np.float32(v)), 1.0]) for i, v in enumerate([2.0**40, -(2.0**40), 3.0, 2.0**38])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((4 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}
    huge = spark.createDataFrame([(1, [3.0e38, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert W.whiten(huge).count() == 2


@pytest.mark.parametrize("cuts", [(1,), (3, 4, 50), (10, 20, 30)])
def test_merging_equals_one_pass(cuts):
    rows = np.floor(np.random.default_rng(1).normal(size=(60, 3)) * 50)
    whole, held = W.Moments.of(rows), None
    for part in np.split(rows, cuts):
        held = W.merged(held, W.Moments.of(part))
    assert held.n == whole.n and held.sums == whole.sums and np.allclose(held.scatter, whole.scatter, rtol=1e-13) and held.low == whole.low
