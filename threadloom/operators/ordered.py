"""Ranks and running sums within groups of any size, over rows that are range-sorted rather than gathered by group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.tables import partitions, stored

#: Running sums are kept modulo MASK + 1, so that adding two of them never leaves a long.
MASK = (1 << 62) - 1


def _starts(keys: list[pa.Array], last: list[pa.Scalar] | None) -> np.ndarray:
    """The rows of a batch whose keys differ from those of the row before; nulls are equal to each other."""
    size = len(keys[0])
    new = np.zeros(size, dtype=bool)
    for i, key in enumerate(keys):
        before = pa.concat_arrays([pa.array([last[i].as_py() if last else None], key.type), key.slice(0, size - 1)])
        differ = pc.or_(pc.fill_null(pc.not_equal(key, before), False), pc.not_equal(pc.is_null(key), pc.is_null(before)))
        new |= differ.to_numpy(zero_copy_only=False)
    new[0] |= last is None
    return np.flatnonzero(new)


def _within(values: np.ndarray, starts: np.ndarray, carried: np.int64) -> np.ndarray:
    """Running sums that start anew at `starts`; rows before the first start go on from `carried`."""
    sums = np.cumsum(values, dtype=np.int64)
    base = np.full(len(values), -carried, dtype=np.int64)
    if len(starts):
        before = np.where(starts > 0, sums[starts - 1], 0)
        at = np.searchsorted(starts, np.arange(len(values)), side="right") - 1
        base = np.where(at >= 0, before[np.maximum(at, 0)], base)
    return (sums - base) & MASK


def _scan(keys: list[str], sums: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, totals, row = None, np.int64(0), [np.int64(0)] * len(sums), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(k) for k in keys]
            starts = _starts(held, last)
            places = _within(np.ones(batch.num_rows, dtype=np.int64), starts, count)
            running = [_within(batch.column(s).to_numpy(zero_copy_only=False), starts, t) for s, t in zip(sums, totals, strict=True)]
            last, count, totals = [h[-1] for h in held], places[-1], [r[-1] for r in running]
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in sums]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows), pa.array(places - 1), *map(pa.array, running)], names=[n for n in batch.schema.names if n not in sums] + ["_row", "_place", *sums])

    return scan


def ranked(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, place: str = "place") -> DataFrame:
    """rows with `place`, each row's place from 0 among the rows of its keys in `order`, and inclusive running sums.

    Each entry of `sums` names a column and the whole numbers to sum up (nulls count as 0), modulo 2**62. Null keys are a
    group of their own. The order should be total; ties are placed in any way. Clashing names: `place` and the names of
    the sums replace columns of rows, keys excepted.

    Rows are range-sorted by keys and order, so a group of any size is spread over tasks. Every task numbers and sums up
    its own rows; the result is written once with its partition, and what a group brings into a partition from those
    before (one row a partition) is added by a broadcast.
    """
    spark, sums = rows.sparkSession, sums or {}
    kept = [c for c in rows.columns if c not in {place, *sums}]
    held, inner = [f"c{kept.index(k)}" for k in keys], {k: f"_s{i}" for i, k in enumerate(sums)}
    by = [F.col(k).asc_nulls_first() for k in held] + [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    slim = rows.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)),
        *(o.alias(f"_o{i}") for i, o in enumerate(order)),
        *(F.coalesce(c.cast("long"), F.lit(0)).alias(inner[k]) for k, c in sums.items()),
    )
    dealt = slim.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop(*(f"_o{i}" for i in range(len(order)))).withColumn("_part", F.spark_partition_id())
    added = T.StructType([T.StructField(n, T.LongType()) for n in ("_row", "_place", *inner.values())])
    fields = T.StructType([f for f in dealt.schema.fields if f.name not in inner.values()] + added.fields)
    local = stored(dealt.mapInArrow(_scan(held, list(inner.values())), fields), "ranked")

    ends = local.groupBy("_part").agg(
        F.min_by(F.struct(*held), "_row").alias("first"), F.max_by(F.struct(*held), "_row").alias("last"), F.max_by(F.struct("_place", *inner.values()), "_row").alias("at")
    )
    long = lambda n: T.StructField(n, T.LongType())
    brought, group, amount = [], None, []
    for part, first, last, at in sorted(ends.collect()):
        into = amount if tuple(first) == group else [0] * len(at)
        brought.append((part, *first, *into))
        own = [at[0] + 1, *at[1:]]
        amount, group = ([(a + b) & MASK for a, b in zip(own, into, strict=True)] if first == last else own), tuple(last)
    names = ["_place", *inner.values()]
    kinds = T.StructType([T.StructField("_part", T.IntegerType()), *(T.StructField(f"h{k}", local.schema[k].dataType) for k in held), *(long(f"h{n}") for n in names)])
    local = local.join(F.broadcast(spark.createDataFrame(brought, kinds)), "_part")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"h{k}")) for k in held))
    value = lambda n: F.when(same, (F.col(n) + F.col(f"h{n}")).bitwiseAND(F.lit(MASK))).otherwise(F.col(n))
    return local.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), value("_place").alias(place), *(value(inner[k]).alias(k) for k in sums))
