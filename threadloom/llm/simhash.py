"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of SEGMENTS equal segments. If two fingerprints differ in t bits or fewer, then some
start on the ring has every chain of l consecutive segments differing in l * t / SEGMENTS bits or fewer: the pigeonring
principle. Budgets under one bit mean equality, so the first EXACT segments of such a chain are equal and serve as join
keys, one for each start; longer chains within their budgets prune candidates before the full Hamming check.

Equal fingerprints are merged first. A bucket of more than BUCKET different fingerprints is not paired up: its members
are linked, exactly, through fingerprints at half the distance (two within 2 bits share a fingerprint within 1 bit of
both), which takes 65 rows a member and no pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bounded_batches, materialize, release, unused
from threadloom.llm.components import components

DISTANCE = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
EXACT = -(-SEGMENTS // DISTANCE) - 1  # the longest chain whose budget is under one bit
CHAIN = SEGMENTS
BUCKET = 16


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8, A-Z lower-cased: bytes know ASCII letters and ASCII white space alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; a text of fewer words is one shingle, one of none has none."""
    found = words_of(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), dtype="<u8", count=len(shingles))


def _majority(hashes: np.ndarray) -> int:
    set_bits = np.zeros(64, dtype=np.int64)
    for block in range(0, len(hashes), 1 << 16):
        part = hashes[block : block + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = set_bits * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of word shingles, repeats included; a bit is set if it is in over half of them."""
    return _majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, null and empty texts included."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t, words) for t in part], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, "long")(F.col(text_col)).alias("fp"))


def _rotated(fp: Column, start: Column) -> Column:
    """The ring read from segment `start` on: bits rotated right by start segments."""
    by = start * WIDTH
    right, left = F.call_function("shiftrightunsigned", fp, by), F.call_function("shiftleft", fp, (F.lit(64) - by) % 64)
    return F.when(start == 0, fp).otherwise(right.bitwiseOR(left))


def _within_budgets(diff: Column) -> Column:
    """Every chain from the start on keeps its budget of l * DISTANCE / SEGMENTS bits; the last is the whole ring."""
    rule = F.lit(True)
    for length in range(EXACT + 1, CHAIN + 1):
        mask = (1 << (WIDTH * length)) - 1
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        rule = rule & (F.bit_count(diff.bitwiseAND(F.lit(mask))) <= F.lit(length * DISTANCE // SEGMENTS))
    return rule


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints of the table fps (fp, unique): they connect exactly those that
    links of DISTANCE bits or fewer connect. Every edge has at most DISTANCE bits between its ends or joins a
    fingerprint to the least member of a star whose members are all within DISTANCE of one another."""
    starts = fps.select("fp", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("start"))
    keyed = starts.select("start", "fp", _rotated(F.col("fp"), F.col("start")).alias("ring"))
    keyed = keyed.withColumn("key", F.col("ring").bitwiseAND(F.lit((1 << (WIDTH * EXACT)) - 1)))
    counts = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(counts, ["start", "key"]).select("start", "key", "fp", "ring", "n"), "simhash-shared")

    small = shared.where(F.col("n") <= BUCKET)
    left = small.select("start", "key", F.col("fp").alias("a"), F.col("ring").alias("x"))
    right = small.select("start", "key", F.col("fp").alias("b"), F.col("ring").alias("y"))
    pairs = left.join(right, ["start", "key"]).where((F.col("a") < F.col("b")) & _within_budgets(F.col("x").bitwiseXOR(F.col("y"))))

    crowded = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    near = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips))).alias("mid"))
    stars = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    hubs = near.join(stars, "mid").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").union(hubs).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links) for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat an id keep a row
    each. Null ids are kept; a component whose ids are all null has a null component_id. An empty table gives no
    rows; other columns are dropped.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col, words), "simhash-fps")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    reach = components(links(fps.select("fp")))
    rooted = fps.join(reach, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("f"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a similarity of five-word shingles.
#
# At a Jaccard similarity of 0.8 whole fingerprints differ in about ten bits of 64, where no partition of the bits
# prunes. So candidates come from a prefix filter, which loses none: put the shingles of every text in one order, then two
# texts at the threshold or above share one of the first n - ceil(threshold * n) + 1 of each. The bounds that follow from
# both sizes and from the places of the first shared shingle hold for every such pair, too; what passes them is compared
# on whole sets. Any order is right. Ours has shingles that are common in a sample of texts last, as they pair up the most.
# Pairs that pigeonring finds are compared as well: within DISTANCE bits, texts of one template may be less alike.
#
# A shingle of this part is its words' 64-bit polynomial hashes combined into 64 bits, so that a block of texts costs a few
# vector operations over its bytes.

SIMILARITY = 0.8
SAMPLE = 16  # one text of so many, by hash, tells which shingles are common
COMMON = 1 << 18
BLOCK = 256  # sets on either side of a comparison of crowded shingles' pairs
HASHED_BYTES = 1 << 18  # bytes of texts that are hashed together, about
_EPS = 1e-9
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POINT = 0x5851F42D4C957F2D
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: A random number for each byte; A-Z have those of a-z.
_OF_BYTE = _mix(_mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP))
_OF_BYTE[65:91] = _OF_BYTE[97:123]


class _Powers:
    """Powers of _POINT and of its inverse modulo 2 ** 64, as many as the longest block so far has bytes."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            series = lambda x: np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, x, dtype=np.uint64)]))
            cls.up, cls.down = series(_POINT), series(pow(_POINT, -1, 1 << 64))
        return cls.up[:n], cls.down[:n]


def _word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of a block's words, which white space or its ends bound."""
    raw = np.frombuffer(block, dtype=np.uint8)
    up, down = _Powers.of(len(raw))
    space = np.concatenate([[True], _IS_SPACE[raw], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_OF_BYTE[raw] * up)])
    return starts, _mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.zeros(0, dtype=np.uint64)


def _combined(single: np.ndarray, size: int) -> np.ndarray:
    n = len(single) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = out * _STEP + single[i : i + n]
    return _mix(out)


def many_combined_hashes(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """64-bit hashes of the word shingles of each text, repeats included; a text of fewer words is one shingle, one of
    none has none. Texts are hashed in blocks of about HASHED_BYTES that end at white space."""
    joined = b" ".join([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])
    found, at = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))], 0
    while at < len(joined):
        gap = _GAP.search(joined, at + HASHED_BYTES)
        end = gap.end() if gap else len(joined)
        starts, hashes = _word_hashes(joined[at:end])
        found.append((starts + at, hashes))
        at = end
    starts, single = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if t and not t.isascii() else len(t or "") for t in texts), dtype=np.int64, count=len(texts))
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)])).tolist()
    whole = _combined(single, words) if len(single) >= words else np.zeros(0, dtype=np.uint64)
    none = np.zeros(0, dtype=np.uint64)
    return [whole[a : b - words + 1] if b - a >= words else _combined(single[a:b], b - a) if b > a else none for a, b in zip(edges, edges[1:], strict=False)]


def combined_hashes(text: str | None, words: int = 5) -> np.ndarray:
    return many_combined_hashes([text], words)[0]


def _held(part: pa.Array, words: int) -> Iterator[np.ndarray]:
    """combined_hashes of every text of an Arrow array, a few texts at a time."""
    held, size = [], 0
    for text in part:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= HASHED_BYTES:
            yield from many_combined_hashes(held, words)
            held, size = [], 0
    yield from many_combined_hashes(held, words)


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Of a set of shingle hashes (sorted, different) the prefix for the threshold, in order.

    common has sorted hashes and their ranks; hashes that are not among them come first, by value.
    """
    if not len(found):
        return found.view(np.int64)
    keep = len(found) - math.ceil(least * len(found) - _EPS) + 1
    values, ranks = common
    if len(values):
        at = np.minimum(np.searchsorted(values, found), len(values) - 1)
        known = values[at] == found
        fresh = found[~known]
        if len(fresh) < keep:
            found = np.concatenate([fresh, found[known][np.argsort(ranks[at[known]])]])
        else:
            found = fresh
    return found[:keep].view(np.int64)


def similarity(a: str | None, b: str | None, words: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; a text of fewer words is one shingle, one of none has none."""

    def shingles(text: str | None) -> set[tuple[bytes, ...]]:
        found = words_of(text)
        return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of different hashes."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return float(not len(y))
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return shared / (len(x) + len(y) - shared)


def _common(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the COMMON most frequent shingles of a sample of texts, sorted, and their ranks, the rarest first."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield _lists([np.unique(h).view(np.int64) for h in _held(part, words)])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("text")).distinct()
    counts = some.select(F.explode(F.arrow_udf(run, "array<long>")("text")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).select("s").toArrow()["s"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], len(found) - order


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64))


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """doc_id, key (of the text), fp, set (digest), n (size) and prefix of each row's shingle set: one narrow pass."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, words))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            fps, names, sizes, heads = [], [], [], []
            for hashes in _held(part, words):
                fps.append(_majority(hashes))
                found = np.unique(hashes)
                names.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                sizes.append(len(found))
                heads.append(prefix(found, common.value, least))
            columns = [np.array(fps, dtype=np.uint64).view(np.int64), pa.array(names, type=pa.string()), np.array(sizes, dtype=np.int32), _lists(heads)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["fp", "set", "n", "prefix"])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    sketch = F.arrow_udf(run, "fp long, set string, n int, prefix array<long>")
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), sketch(F.col(text_col)).alias("s")).select("doc_id", "key", "s.*")


def text_key(text_col: str) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32)


def _shared(sets: DataFrame) -> DataFrame:
    """The prefixes' shingles that more sets than one have in theirs: shingle, sid, n, at (place in the prefix), prev (the
    shingle before), with the number of those sets."""
    parts = F.expr("transform(prefix, (x, i) -> struct(x as shingle, i as at, if(i = 0, null, prefix[i - 1]) as prev))")
    both = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p.at").cast("long"))  # one number less to shuffle
    held = sets.select("sid", "n", F.explode(parts).alias("p")).select("sid", both.alias("both"), "p.shingle", "p.prev")
    counts = sets.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    found = held.join(counts, "shingle")
    return found.select("shingle", "sid", F.shiftright("both", 32).cast("int").alias("n"), F.col("both").cast("long").bitwiseAND((1 << 32) - 1).cast("int").alias("at"), "prev", "sets")


def _possible(a: str, b: str, least: float) -> Column:
    """Whether sizes and places leave room for the threshold, if the sets share no shingle before this one."""
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (a, b))
    sizes = (n >= least * m - _EPS) & (m >= least * n - _EPS)
    return sizes & (1 + F.least(n - i - 1, m - j - 1) >= least / (1 + least) * (n + m) - _EPS)


def _paired(held: DataFrame, least: float, *more: str, apart: Column | None = None) -> DataFrame:
    """Pairs (a, b) of sids that may reach the threshold, of all that share a shingle (and are apart, a rule on x and y);
    of the columns `more` both values, as x_ and y_.

    A pair at the threshold passes at its first shared shingle; where the shingles before are equal, this is not it.
    """
    x, y = held.alias("x"), held.alias("y")
    new = F.col("x.prev").isNull() | F.col("y.prev").isNull() | (F.col("x.prev") != F.col("y.prev"))
    rule = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.sid") < F.col("y.sid")) & new & _possible("x", "y", least)
    if apart is not None:
        rule = rule & apart
    both = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in more for side in "xy"]
    return x.join(y, rule).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), *both).distinct()


def _candidates(shared: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sids, a < b, to compare first: all of shingles in BUCKET sets or fewer, and those with the head of
    others, the set that has the shingle first in its prefix."""
    large = shared.where(F.col("sets") > BUCKET)
    heads = large.groupBy("shingle").agg(F.min(F.struct("at", "sid", "n")).alias("y"))
    heads = large.join(heads, "shingle").select(F.struct("n", "at", "sid").alias("x"), "y")
    heads = heads.where((F.col("x.sid") != F.col("y.sid")) & _possible("x", "y", least))
    heads = heads.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
    return _paired(shared.where(F.col("sets") <= BUCKET), least).union(heads).distinct()


def _remaining(shared: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sids in crowded shingles that may reach the threshold and are not in one component already, with
    the blocks x_block and y_block of their ends: BLOCK sets of one crowded shingle, about."""
    large = shared.where(F.col("sets") > BUCKET).select("shingle", "sid", "n", "at", "prev", "sets").join(roots, "sid")
    several = large.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    large = materialize(large.join(several.select("shingle"), "shingle"), "near-crowded")
    homes = large.groupBy("sid").agg(F.min(F.struct("shingle", "sets")).alias("h"))
    place = F.xxhash64("h.shingle", F.pmod(F.xxhash64("sid"), F.ceil(F.col("h.sets") / BLOCK)))
    placed = large.join(homes.select("sid", place.alias("block")), "sid")
    return _paired(placed, least, "block", apart=F.col("x.root") != F.col("y.root"))


def _sets_of(wanted: DataFrame, sets: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """sid and hashes (sorted, different, as bytes) of the wanted sids' whole shingle sets, each from one text of the set."""
    spot = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id0"), F.col(c).isNull().alias("none"))
    owners = wanted.distinct().join(sets.select("sid", "key"), "sid").join(nodes.select("key", "id"), "key")
    owners = owners.select("sid", "key", *spot("id"))
    texts = docs.select(text_key(text_col).alias("key"), *spot(id_col), F.col(text_col).alias("text"))
    one = texts.join(owners, ["key", "id0", "none"]).dropDuplicates(["key", "id0", "none"])

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([np.unique(h).tobytes() for h in _held(part, words)], type=pa.binary())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return materialize(one.select("sid", F.arrow_udf(run, "binary")("text").alias("hashes")), "near-hashes")


def _close(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) of sids those of similarity least or more."""

    def compare(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in parts:
            both = zip(x, y, strict=True)
            yield pa.array([_jaccard(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in p)) >= least - _EPS for p in both], type=pa.bool_())

    compare.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    both = pairs.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
    return materialize(both.where(F.arrow_udf(compare, "boolean")("x", "y")).select("a", "b"), "near-close")


def overlaps(held: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many hashes the sets of each pair (rows of two places in held) share.

    Many pairs among few sets are counted by products of membership matrices, COLUMNS different hashes at a time.
    """
    if len(pairs) <= 4 * len(held):
        common = lambda x, y: int(np.isin(x, y, assume_unique=True).sum()) if len(x) and len(y) else 0
        return np.array([common(held[a], held[b]) for a, b in pairs], dtype=np.int64)
    places = np.repeat(np.arange(len(held)), [len(h) for h in held])
    different, column = np.unique(np.concatenate(held), return_inverse=True)
    order = np.argsort(column, kind="stable")
    places, column = places[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(different) + COLUMNS, COLUMNS))
    both = np.zeros((len(held), len(held)), dtype=np.float32)
    for k in range(len(cuts) - 1):
        some = np.zeros((len(held), COLUMNS), dtype=np.float32)
        some[places[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * COLUMNS] = 1
        both += some @ some.T
    return np.rint(both[pairs[:, 0], pairs[:, 1]]).astype(np.int64)


COLUMNS = 4096


def _linked(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect what the pairs of similarity least or more connect, compared block against block.

    A task meets 2 * BLOCK sets at once, about, and gives a spanning forest of their links, not all of them.
    """
    keyed = materialize(pairs.select("a", "b", F.least("x_block", "y_block").alias("p"), F.greatest("x_block", "y_block").alias("q")), "near-remaining")
    ends = keyed.select("p", "q", F.col("a").alias("sid")).union(keyed.select("p", "q", "b")).distinct()
    members = ends.join(hashes, "sid").select(F.col("p").alias("mp"), F.col("q").alias("mq"), "sid", "hashes")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sids = right["sid"].to_numpy()
        order = np.argsort(sids)
        held = [np.frombuffer(right["hashes"][int(i)].as_buffer(), dtype=np.uint64) for i in order]
        ends = np.stack([np.searchsorted(sids[order], left[c].to_numpy()) for c in "ab"], axis=1)
        sizes = np.array([len(h) for h in held])
        shared = overlaps(held, ends)
        near = shared >= (least - _EPS) * (sizes[ends[:, 0]] + sizes[ends[:, 1]] - shared)
        root, kept = list(range(len(held))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in ends[near].tolist():
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                kept.append((a, b))
        found = sids[order][np.array(kept, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    compare.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return materialize(keyed.groupBy("p", "q").cogroup(members.groupBy("mp", "mq")).applyInArrow(compare, "a long, b long"), "near-linked")


def _rooted(ids: DataFrame, reach: DataFrame) -> DataFrame:
    """sid and root of every sid; those without edges are their own."""
    return ids.select("sid").join(reach.toDF("node", "root"), F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the least id (null ids last), then text hash.

    Groups are the components over equal texts and all pairs of similarity `least` or more (of `words`-word shingles).
    Null and empty texts are equal texts. Equal rows leave one. All columns are kept.

    Texts of one shingle set are compared as one. Candidates are sets whose fingerprints are within DISTANCE bits and sets
    that share a shingle of their prefixes. Crowded shingles compare each set with one of theirs first; pairs in them that
    are in one component by then need no comparison, all others get theirs.
    """
    with bounded_batches(docs.sparkSession):
        return _kept_first(docs, id_col, text_col, words, least)


def _kept_first(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    spark = docs.sparkSession
    rows = materialize(_sketches(docs, id_col, text_col, words, least), "near-sketches")
    repeats = not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    nodes = materialize(rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("set").alias("set"), F.min("doc_id").alias("id")), "near-nodes")
    full = rows.groupBy("set").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("key").alias("key"))
    full = materialize(full.withColumn("sid", F.monotonically_increasing_id()), "near-full")
    sets = materialize(full.select("sid", "set", "key"), "near-sets")
    shared = materialize(_shared(full), "near-shared")
    release(spark, rows, full)

    # Candidates by fingerprint: equal ones meet one of theirs, different ones those within DISTANCE bits.
    prints = nodes.join(sets.select("set", "sid"), "set").select("fp", "sid").distinct()
    firsts = materialize(prints.groupBy("fp").agg(F.min("sid").alias("first"), F.count("*").alias("sids")), "near-prints")
    by_print = prints.join(firsts.where("sids > 1"), "fp").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    ends = firsts.select("fp", "first")
    by_bits = links(ends.select("fp")).join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = materialize(_candidates(shared, least).union(by_print).union(by_bits).distinct(), "near-candidates")
    crowded = shared.where(F.col("sets") > BUCKET).select("sid")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(crowded)
    hashes = _sets_of(wanted, sets, nodes, docs, id_col, text_col, words)
    release(spark)
    close = _close(pairs, hashes, least)
    release(spark)

    reach = components(close)
    roots = materialize(_rooted(sets, reach), "near-roots")

    rest = _remaining(shared, roots, least).join(pairs, ["a", "b"], "left_anti")
    release(spark)
    more = _linked(rest, hashes, least)
    release(spark, hashes, shared, pairs)
    if not more.isEmpty():
        more = more.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(more).toDF("old", "new")
        roots = roots.join(joined, F.col("root") == F.col("old"), "left").select("sid", F.coalesce("new", "root").alias("root"))
    placed = nodes.join(sets.select("set", "sid"), "set").join(roots, "sid").select("root", "key", "id")
    chosen = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("c"))
    first, own = unused(docs, "_id", "_key")
    chosen = materialize(chosen.select(F.col("c.id").alias(first), F.col("c.key").alias(own)), "near-chosen")
    kept = docs.join(chosen, F.col(id_col).eqNullSafe(F.col(first)) & (text_key(text_col) == F.col(own)), "left_semi")
    return kept.withColumn(own, text_key(text_col)).dropDuplicates([id_col, own]).drop(own) if repeats else kept
