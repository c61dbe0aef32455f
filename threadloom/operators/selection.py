"""Exact order statistics by radix selection: no task sorts or gathers the values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.tables import counted

#: Bits that a level decides, so 2**BITS counts a wanted place come to the driver; and values that it fetches at the end.
BITS, FEW = 12, 1 << 14
_TOP = 1 << 63


def _ordered(values: np.ndarray) -> np.ndarray:
    """Bit patterns of doubles, turned so that they are ordered as the doubles are, as longs; NaN comes last."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _double(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF))[0]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place, column in enumerate(batch.columns):
            keys = pa.array(_ordered(column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), place, dtype=np.int32)), keys], names=["place", "key"])


def summaries(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """(mean, exact median) of each column of numbers, None without values; of an even number the mean of the middle two.

    Nulls are left out and NaN is the greatest value. Values become ordered 64-bit keys, written once; the write itself
    takes means, extremes and numbers. Each level counts, for all columns in one job, the keys under the wanted prefixes
    by their next BITS bits; the counts tell which prefix goes on. What is left of few keys is fetched. So there are at
    most 64 / BITS + 1 jobs more, and no task meets all values.
    """
    seen, of = Observation(), lambda i: F.when(F.col("place") == i, F.col("key"))
    values = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    values = values.observe(seen, *(F.avg(c).alias(c) for c in values.columns))
    ends = {f"{what}{i}": f(of(i)) for what, f in (("low", F.min), ("high", F.max), ("n", F.count)) for i in range(len(columns))}
    keys, held = counted(values.mapInArrow(_keys, "place int, key long"), "selection", **ends)
    extent = {i: (held[f"low{i}"], held[f"high{i}"], held[f"n{i}"]) for i in range(len(columns)) if held[f"n{i}"]}
    # A wanted value: its column, the bits that are left, the prefix above them, and its place among the keys under it.
    wanted = {}
    for column, (low, high, n) in extent.items():
        left = ((low ^ high) & (2 * _TOP - 1)).bit_length()
        for spot in {(n - 1) // 2, n // 2}:
            wanted[column, spot] = (left, low >> left if left < 64 else 0, spot, n)
    found: dict[tuple[int, int], int] = {}
    while wanted:
        for what, (left, prefix, _, _) in list(wanted.items()):
            if not left:
                found[what] = prefix
                del wanted[what]
        few = {(column, left, prefix) for (column, _), (left, prefix, _, n) in wanted.items() if n <= FEW}
        if few:
            held: dict[tuple, list[int]] = {}
            table = keys.where(_under(few)).toArrow()
            for at, key in zip(table["place"].to_pylist(), table["key"].to_pylist(), strict=True):
                for one in few:
                    if one[0] == at and _prefix(key, one[1]) == one[2]:
                        held.setdefault(one, []).append(key)
            for (column, spot), (left, prefix, place, _) in list(wanted.items()):
                if (column, left, prefix) in few:
                    found[column, spot] = sorted(held[column, left, prefix])[place]
                    del wanted[column, spot]
        many = {(column, left, prefix) for (column, _), (left, prefix, _, _) in wanted.items()}
        if not many:
            continue
        counts: dict[tuple, list[tuple[int, int]]] = {one: [] for one in many}
        branch = None
        for column, left, prefix in sorted(many):
            below = max(0, left - BITS)
            hit = F.struct(F.lit(left).alias("left"), F.lit(prefix).cast("long").alias("prefix"), _shifted(below).alias("next"))
            branch = (F.when if branch is None else branch.when)(_under({(column, left, prefix)}), hit)
        for r in keys.select("place", branch.alias("b")).where("b is not null").groupBy("place", "b").count().collect():
            counts[r["place"], r["b"]["left"], r["b"]["prefix"]].append((r["b"]["next"], r["count"]))
        for what, (left, prefix, place, _) in list(wanted.items()):
            for following, n in sorted(counts[what[0], left, prefix]):
                if place < n:
                    wanted[what] = (max(0, left - BITS), following, place, n)
                    break
                place -= n
    out: dict[str, tuple[float | None, float | None]] = dict.fromkeys(columns, (None, None))
    for column, (_, _, n) in extent.items():
        low, high = (_double(found[column, spot]) for spot in ((n - 1) // 2, n // 2))
        middle = low if low == high else low + (high - low) / 2 if np.isfinite([low, high]).all() else (low + high) / 2
        out[columns[column]] = (seen.get[f"c{column}"], middle)
    return out


def _prefix(key: int, left: int) -> int:
    return key >> left if left < 64 else 0


def _shifted(left: int):
    """Spark shifts longs by at most 63 bits; with 64 left there is no prefix yet."""
    return F.shiftright("key", left) if left < 64 else F.lit(0).cast("long")


def _under(those: set[tuple[int, int, int]]):
    out = F.lit(False)
    for column, left, prefix in sorted(those):
        out = out | ((F.col("place") == column) & (_shifted(left) == prefix))
    return out
