"""Neighbours by blocks against all similarities."""

from __future__ import annotations

import numpy as np
import pytest

from threadloom.operators import similarity as S

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(asked, base, k):
    unit = lambda v: np.array(v, dtype=np.float32).astype(float) / (np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) or 1)
    out = set()
    for i, v in asked:
        near = sorted((-round(float(unit(v) @ unit(w)), S.DIGITS), j) for j, w in base if j != i)
        out |= {(i, j, -s + 0.0, n + 1) for n, (s, j) in enumerate(near[:k])}
    return out


def clusters(n, dims, groups, spread, seed=0):
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(groups, dims))
    return [(i, [float(x) for x in centres[i % groups] + spread * gen.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "copies"), [(0.05, 0), (2.0, 0), (0.3, 80)])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, spread, copies):
    monkeypatch.setattr(S, "SIDE", 64)
    monkeypatch.setattr(S, "CHUNK", 3)
    rows = clusters(500, 6, 9, spread)
    rows += [(1000 + i, rows[0][1]) for i in range(copies)] + [(5000, [0.0] * 6)]
    asked = [r for r in rows if r[0] % 2 == 0]
    frame = lambda r: spark.createDataFrame(r + [(None, [1.0] * 6), (9999, None)], SCHEMA).repartition(4)
    got = {(r.query, r.neighbour, r.similarity + 0.0, r.place) for r in S.top_k(frame(asked), frame(rows), 5, block=10).collect()}
    expected = by_hand(asked, rows, 5)
    close = lambda found: {(q, n, p) for q, n, _, p in found}
    assert len(got) == len(expected) and len(close(got) - close(expected)) <= len(expected) * 0.01
    assert {(q, p): round(s, 5) for q, _, s, p in got} == {(q, p): round(s, 5) for q, _, s, p in expected}


def test_bounds_skip_blocks(spark, monkeypatch):
    """Far clusters are never compared: with tight cones, most pairs of blocks drop out before their vectors meet."""
    monkeypatch.setattr(S, "SIDE", 64)
    compared = []
    whole = S._compared
    monkeypatch.setattr(S, "_compared", lambda pairs, *more: compared.append(pairs.count()) or whole(pairs, *more))
    rows = clusters(1500, 8, 12, 0.01)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert S.top_k(frame, frame, 3, block=10).count() == 4500
    assert sum(compared) < 0.5 * S.blocks(frame.selectExpr("vec_id AS id", "embedding AS v"), 64).count() ** 2


def test_fewer_rows_than_wanted(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], SCHEMA)
    assert S.top_k(frame, frame, 9, block=1).count() == 12
