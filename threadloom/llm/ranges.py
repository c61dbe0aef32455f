"""Ranges of a key with about equal weight, whose bounds depend on the rows alone."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that the first histogram and each refinement add to a bin's prefix.
FIRST, STEP = 10, 6
_LOW = -(1 << 63)


def splitters(rows: DataFrame, key: str, weight: Column, shards: int) -> list[int]:
    """At most shards - 1 ascending bounds that cut rows into ranges of about equal weight.

    Bins are prefixes of the key's 64 bits (with the sign turned, so that they are ordered as the keys are), below the
    prefix that all keys share. A bin heavier than a shard is refined by STEP bits until it is not or holds one key. One
    job refines all bins of a level, so 10 jobs are the most, and 2 ** STEP rows a shard come to the driver. The bounds
    depend on the rows alone; keys may span all 64 bits.
    """
    low, high, total = rows.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None or shards < 2:
        return []
    goal, bins, bounds = total / shards, [], []
    turned = F.col(key).cast("long").bitwiseXOR(F.lit(_LOW))
    prefix = lambda shift: F.call_function("shiftrightunsigned", turned, F.lit(shift))
    shift, within = max(0, ((low ^ high) & (1 << 64) - 1).bit_length() - FIRST), rows.where(F.col(key).isNotNull())
    while True:
        heavy = []
        for n, w in within.groupBy(prefix(shift).alias("bin")).agg(F.sum(weight).alias("w")).collect():
            if w > goal and shift:
                heavy.append(n)
            else:
                bins.append((((n << shift) & (1 << 64) - 1) + _LOW, w))
        if not heavy:
            break
        within = rows.where(F.col(key).isNotNull() & prefix(shift).isin(heavy))
        shift = max(0, shift - STEP)
    run = 0
    for start, w in sorted(bins):
        if run >= total / shards * (len(bounds) + 1):
            bounds.append(max(start, low))
        run += w
    return bounds


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below key; null keys go first.

    Bounds come as literals, one a shard, in blocks of about the root of their number: first the block is found, then
    the place in it.
    """
    if not bounds:
        return F.lit(0)
    below = lambda held: F.size(F.filter(held, lambda b: b <= key))
    side = isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    if len(blocks) == 1:
        return F.coalesce(below(F.array(*map(F.lit, bounds))), F.lit(0))
    block = below(F.array(*(F.lit(b[0]) for b in blocks)))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(block, F.lit(1)))
    return F.coalesce((F.greatest(block, F.lit(1)) - 1) * side + below(inside), F.lit(0))

