"""Sharding by a keyed permutation of global row numbers.

A Feistel network over pairs (left, right) of base `side`, side * side >= N, permutes [0, side * side); values that
land at N or above are walked along their cycle until they fall below N, which gives a permutation of [0, N). The
position p of a row then gives shard p % shards and slot p // shards, so shard sizes in rows differ by one at most and
anyone who knows (N, shards, seed) can compute where a row went, or with `unpermute` which row sits in a slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import number_rows

ROUNDS = 4
_MASK = (1 << 31) - 1


def side_of(total: int) -> int:
    return max(1, math.isqrt(max(total, 1) - 1) + 1) if total > 1 else 1


def _round(half: np.ndarray, key: int, side: int) -> np.ndarray:
    """Keyed mixing of one half; every product stays under 2**62, so any engine with 64-bit integers agrees."""
    h = (half + key) & _MASK
    h = (h * 73244475) & _MASK
    h = h ^ (h >> 15)
    h = (h * 668265261) & _MASK
    h = h ^ (h >> 13)
    return h % side


def round_keys(seed: int) -> list[int]:
    return [(seed * 1000003 + r * 7919 + 12345) & _MASK for r in range(ROUNDS)]


def _once(x: np.ndarray, side: int, keys: list[int]) -> np.ndarray:
    left, right = x // side, x % side
    for key in keys:
        left, right = right, (left + _round(right, key, side)) % side
    return left * side + right


def _back(x: np.ndarray, side: int, keys: list[int]) -> np.ndarray:
    left, right = x // side, x % side
    for key in reversed(keys):
        left, right = (right - _round(left, key, side)) % side, left
    return left * side + right


def _walk(step, x: np.ndarray, total: int, seed: int) -> np.ndarray:
    side, keys = side_of(total), round_keys(seed)
    out = step(np.asarray(x, dtype=np.int64), side, keys)
    while (outside := out >= total).any():
        out[outside] = step(out[outside], side, keys)
    return out


def permute(x: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Positions of row numbers x (all in [0, total)) under the keyed permutation."""
    return _walk(_once, x, total, seed)


def unpermute(x: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Row numbers at positions x: the inverse of permute()."""
    return _walk(_back, x, total, seed)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into shards 0..shards-1 under the law `rows`: counts differ by one at most, slots are gapless from 0.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; null text counts no bytes), text_crc32 (of the UTF-8 bytes;
    null text as empty: 0), law, shard, slot, grown_shard (null under this law).

    Row numbers follow (id, text hash), nulls first; rows equal in both are interchangeable, so results are
    reproducible. Null and repeated ids are ordinary rows; an empty table gives no rows; other columns are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("_tie"),
    )
    numbered, total = number_rows(rows, [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("size")])

    def deal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(), total, seed))

    position = F.pandas_udf(deal, "long")(F.col("row_no"))
    return numbered.withColumn("_at", position).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
