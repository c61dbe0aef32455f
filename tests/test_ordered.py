"""Grouped ranks and running sums over partition borders, against a loop over sorted rows."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from threadloom.operators import authors, selection
from threadloom.operators.ordered import MASK, ranked


def by_hand(rows):
    """rows (key, at, value): {(key, at): (place, sum)}."""
    out, before = {}, None
    for key, at, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if before is None or before[0] != key:
            place, total = 0, 0
        else:
            place, total = before[1] + 1, before[2]
        total = (total + (value or 0)) & MASK
        out[key, at], before = (place, total), (key, place, total)
    return out


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_ranked_with_a_hot_group(spark, share):
    pick = random.Random(5)
    rows = [("hot" if pick.random() < share else pick.choice([None, "", "a", "b", "é", "z"]), n, pick.choice([None, 0, 5, MASK - 1])) for n in range(3000)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at long, value long").repartition(5)
    got = {(r.key, r.at): (r.place, r.total) for r in ranked(df, ["key"], [F.col("at")], {"total": F.col("value")}).collect()}
    assert got == by_hand(rows)


def test_ranked_keeps_columns_and_handles_few_rows(spark):
    df = spark.createDataFrame([(1, 2, "x", 9)], "key long, c0 long, _k0 string, place long")
    assert ranked(df, ["key", "c0"], [F.col("_k0")]).collect() == [(1, 2, "x", 0)]
    assert ranked(df.limit(0), ["key"], [F.col("c0")]).collect() == []


@pytest.mark.parametrize("few", [0, 50])
def test_medians_by_selection(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    pick = random.Random(9)
    tables = {
        "a": [pick.gauss(0, 1e3) for _ in range(1001)] + [0.0, -0.0, 1e-300, -1e300, float("inf")],
        "b": [pick.choice([2.5, 2.5, 7.0]) for _ in range(900)],
        "c": [float(pick.randint(-(10**6), 10**6)) for _ in range(800)] + [None] * 50,
        "d": [None] * 30,
        "e": [-1.0, 4.0],
        "f": [float("nan")] * 3 + [1.0, 2.0],
    }
    size = max(map(len, tables.values()))
    rows = list(zip(*(v + [None] * (size - len(v)) for v in tables.values()), strict=True))
    found = selection.summaries(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in tables)), list(tables))
    got = {c: middle for c, (_, middle) in found.items()}
    assert found["d"] == (None, None) and found["e"] == (1.5, 1.5) and got["f"] != got["f"]
    assert {c: got[c] for c in "abce"} == {c: median(x for x in tables[c] if x is not None) for c in "abce"}


def test_parts_of_a_hot_author_join_to_its_text(spark):
    pick = random.Random(3)
    rows = [(n, "hot" if n % 3 else pick.choice(["a", "b", None]), None if n % 11 == 0 else "x" * pick.randint(0, 30)) for n in range(2000)]
    df = spark.createDataFrame(rows, "at long, author string, line string").repartition(6)
    parts = authors.text_parts(df, F.col("line"), ["at"], size=100).collect()
    whole = {r.author: r.formatted_comment for r in authors.texts(df, F.col("line"), ["at"]).collect()}
    for author in whole:
        mine = [r for r in sorted(parts, key=lambda r: r.part) if r.author == author]
        assert "\n".join(r.formatted_comment for r in mine) == whole[author]
        assert all(len(r.formatted_comment) <= 131 for r in mine)
    assert len([r for r in parts if r.author == "hot"]) > 100
