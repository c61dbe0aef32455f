"""Prefix tries over conversations, built as Patricia tries: only branch, end and leaf points are made, edges stay compressed.

A conversation is a path of turns. Turns are range-sorted by conversation, and a running sum of hashes of (depth, turn)
names every prefix, so no conversation is gathered in one row. The least and the greatest next turn of a prefix tell
whether it branches. Every node belongs to its smallest member, whose nodes are one path downwards, and on that path to
the first point at or below it. Counts are summed up on the points alone, by doubling ancestors, in log2(height) rounds;
the nodes between two points get theirs from the point below and from the running words along the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import drop_table, materialize, partitions
from threadloom.operators.ordered import MASK, ranked

#: Member ids that are joined into one text before they are hashed.
CHUNK = 4096
WORDS = r"[^\x20\x09-\x0D]+"
_PREFIX = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_id, words): every turn of a conversation in order, numbered by `at` from 0.

    The order is by turn, null first, ties by a hash of role and text, so that rows that repeat are turns of their own.
    turn_id is 128 bits of SHA-256 over role and text; null role and text are empty. Rows without a conv_id drop out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_id"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return ranked(rows.where("conv_id is not null"), ["conv_id"], [F.col("turn"), F.col("turn_id")], place="at").drop("turn")


def kept_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % 4).cast("long")


def rebuilt(own: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % family and go on with their own after h.

    `own` comes from turns(). Returns the turns (conv_id, depth from 1, turn_id, words) and all conversations (conv_id),
    those without turns included. h is kept_turns(conv_id), 3 at most, so a conversation lends three turns to `family`
    others; % keeps the sign of c.
    """
    h = kept_turns(F.col("conv_id"))
    convs = own.where("at = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    heads = own.where((F.col("conv_id") % family == 0) & (F.col("at") < 3)).select(F.col("conv_id").alias("base"), "at", "turn_id", "words")
    lent = convs.join(heads, "base").where("at < h")
    missing = convs.join(lent.groupBy("conv_id").agg(F.count("*").alias("k")), "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("k", F.lit(0))).alias("missing")).where("missing > 0")
    rest = own.where(F.col("at") >= h).join(missing, "conv_id", "left")
    depth = F.col("at") + 1 - F.coalesce("missing", F.lit(0))
    both = rest.select("conv_id", depth.alias("depth"), "turn_id", "words").union(lent.select("conv_id", (F.col("at") + 1).alias("depth"), "turn_id", "words"))
    return both, convs.select("conv_id")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each prefix's chunks, which follow each other; one chunk is held at a time."""
    key, held = None, None
    for batch in batches:
        keys, hashes = [], []
        for *at, text in zip(*(batch.column(c).to_pylist() for c in (*_PREFIX, "text")), strict=True):
            if at == key:
                held.update(b"," + text.encode())
                continue
            if key is not None:
                keys.append(key)
                hashes.append(held.hexdigest())
            key, held = at, hashlib.sha256(text.encode())
        yield _named(keys, hashes)
    if key is not None:
        yield _named([key], [held.hexdigest()])


def _named(keys: list[list[int]], hashes: list[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string())], names=[*_PREFIX, "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) over the ascending ids of the conversations that end there, whatever their number.

    Ids are ranked over tasks and joined in chunks; SHA-256 itself is sequential, so a prefix's chunks stream through
    one task, which holds one of them.
    """
    placed = ranked(ends, _PREFIX, [F.col("conv_id")])
    chunks = placed.groupBy(*_PREFIX, F.expr(f"place div {CHUNK}").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("text"))
    streamed = chunks.repartition(partitions(ends.sparkSession), *_PREFIX).sortWithinPartitions(*_PREFIX, "chunk").drop("chunk")
    return streamed.mapInArrow(_hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def _prefixes(seqs: DataFrame) -> DataFrame:
    """seqs with p1, p2, which name the prefix that ends in the turn, q1, q2, its parent, and total, the words so far."""
    parts = [F.xxhash64(F.lit(n), "depth", "turn_id").bitwiseAND(F.lit(MASK)) for n in (1, 2)]
    rows = seqs.select("conv_id", "depth", "words", parts[0].alias("x1"), parts[1].alias("x2"))
    summed = ranked(rows, ["conv_id"], [F.col("depth")], {"p1": F.col("x1"), "p2": F.col("x2"), "total": F.col("words")})
    less = lambda n: (F.col(f"p{n}") - F.col(f"x{n}")).bitwiseAND(F.lit(MASK))
    return summed.select("conv_id", *_PREFIX, less(1).alias("q1"), less(2).alias("q2"), "words", "total")


def _nodes(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """One row a prefix: its smallest member, parent, words, and whether it is a point and a leaf.

    Turns name their own prefix and the one before, conversations the one where they end. All of it combines in the map
    tasks, so prefixes that most conversations share are cheap.
    """
    none = F.lit(None).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    own = rows.select(*_PREFIX, F.col("conv_id").alias("m"), "q1", "q2", "words", "total", none.alias("n1"), none.alias("n2"), zero.alias("ends"))
    before = rows.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("conv_id").alias("m"),
        none.alias("q1"), none.alias("q2"), none.alias("words"), none.alias("total"), F.col("p1").alias("n1"), F.col("p2").alias("n2"), zero.alias("ends"))
    last = ends.select(*_PREFIX, F.col("conv_id").alias("m"), *(none.alias(c) for c in ("q1", "q2", "words", "total", "n1", "n2")), one.alias("ends"))
    found = own.union(before).union(last).groupBy(*_PREFIX).agg(
        F.min("m").alias("m"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.coalesce(F.max("words"), zero).alias("words"), F.coalesce(F.max("total"), zero).alias("total"),
        F.min("n1").alias("low1"), F.max("n1").alias("high1"), F.min("n2").alias("low2"), F.max("n2").alias("high2"), F.sum("ends").alias("ends"),
    )
    branch = (F.col("low1") != F.col("high1")) | (F.col("low2") != F.col("high2"))
    point = (F.col("depth") == 0) | (F.col("ends") > 0) | F.coalesce(branch, F.lit(False))
    return found.select(*_PREFIX, "m", "q1", "q2", "words", "total", "ends", point.alias("point"), F.col("low1").isNull().cast("long").alias("leaf"))


def _summed_up(tree: DataFrame) -> DataFrame:
    """tree (id, above, values...) with each value summed up over the point's subtree.

    After round k a point holds the sum over what is less than 2**k points below it, and `above` is 2**k points up.
    """
    values = [c for c in tree.columns if c not in ("id", "above")]
    tree = materialize(tree, "trie-sums")
    while not tree.where("above is not null").isEmpty():
        below = tree.where("above is not null").groupBy("above").agg(*(F.sum(v).alias(f"more_{v}") for v in values)).withColumnRenamed("above", "id")
        further = tree.select(F.col("id").alias("above"), F.col("above").alias("next"))
        more = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        then = materialize(tree.join(below, "id", "left").join(further, "above", "left").select("id", F.col("next").alias("above"), *more), "trie-sums")
        drop_table(tree)
        tree = then
    return tree.drop("above")


def prefix_trie(seqs: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie over `seqs` (conv_id, depth from 1 without gaps, turn_id, words) and the conversations `convs`.

    Returns conv_id (smallest member; with depth it names the node and its last turn), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. The root has depth 0 and no parent; a conversation without turns
    ends there. No conversations give no nodes. Prefixes are told apart by 124 bits of hash.
    """
    rows = _prefixes(seqs)
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in _PREFIX)).alias("at")
    last = convs.select("conv_id", zero).union(rows.select("conv_id", F.struct(*_PREFIX).alias("at"))).groupBy("conv_id").agg(F.max("at").alias("at"))
    ends = materialize(last.select("conv_id", "at.*"), "trie-ends")
    nodes = ranked(_nodes(rows, ends), ["m"], [-F.col("depth")], {"edge": F.col("point").cast("long")})
    hashes = materialize(_end_hashes(ends), "trie-hashes")
    drop_table(ends)
    drop_table(rows)

    # Points, each with the edge above it. Edges are numbered upwards along the path of their smallest member.
    points = nodes.where("point").join(hashes, _PREFIX, "left").withColumn("id", F.monotonically_increasing_id())
    points = materialize(points.select("id", "m", "edge", *_PREFIX, "total", "ends", "leaf", "ends_sha256"), "trie-points")
    drop_table(hashes)
    tops = nodes.groupBy("m").agg(F.min_by(F.struct("depth", "q1", "q2"), "depth").alias("top"), F.max("edge").alias("edge"))
    tops = tops.select("m", "edge", F.col("top.depth").alias("top"), (F.col("top.depth") - 1).alias("depth"), F.col("top.q1").alias("p1"), F.col("top.q2").alias("p2"))
    hung = tops.join(points.select(*_PREFIX, F.col("id").alias("above"), F.col("total").alias("so_far"), F.col("m").alias("parent")), _PREFIX, "left")
    none = F.lit(None).cast("long")
    along = points.select("m", (F.col("edge") - 1).alias("edge"), none.alias("top"), F.col("id").alias("above"), F.col("total").alias("so_far"), none.alias("parent")).where("edge > 0")
    edges = materialize(points.join(along.union(hung.select(along.columns)), ["m", "edge"]), "trie-edges")
    drop_table(points)
    sums = _summed_up(edges.select("id", "above", F.col("ends").alias("n"), (F.col("ends") * F.col("total")).alias("all_words"), F.col("leaf").alias("leaves"),
        (F.col("total") - F.coalesce("so_far", F.lit(0))).alias("edge_words")))
    below = edges.where("above is not null").groupBy(F.col("above").alias("id")).agg(F.count("*").alias("children"))
    known = edges.select("id", "m", "edge", "top", "parent", "ends_sha256", F.col("total").alias("end_total"), F.coalesce("so_far", F.lit(0)).alias("so_far"))
    known = known.join(sums, "id").join(below, "id", "left")

    # Nodes of an edge: all of them have the members and the leaves of the point below.
    joined = nodes.select("m", "edge", "depth", "words", "total", "point").join(known, ["m", "edge"])
    before = F.col("total") - F.col("words")
    suffix = F.col("end_total") - before
    beneath = F.col("edge_words") - (F.col("end_total") - F.col("so_far"))
    return joined.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.when(F.coalesce(F.col("depth") == F.col("top"), F.lit(False)), F.col("parent")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("point"), F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("all_words") - F.col("n") * before - beneath - suffix).alias("saved_tokens"),
        F.when(F.col("point") & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() over the rebuilt() conversations; other columns are dropped, an empty table gives no rows."""
    own = turns(conversations)
    nodes = prefix_trie(*rebuilt(own))
    drop_table(own)
    return nodes
