"""Exact nearest neighbours by cosine: one block of queries goes to all rows, many blocks meet blocks of rows in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.ordered import ranked
from threadloom.tables import partitions, stored

BLOCK = 2048
DIGITS = 6
#: Vectors a block, fewer where they are long; block summaries that meet in one row; what angles may be off by.
SIDE, CHUNK, SLACK = 2048, 1024, 1e-7


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_k(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, neighbour, similarity, place): the k rows of base nearest to each query by cosine, itself (by id) left out.

    Vectors are normalised; similarities are rounded to DIGITS places and ties go to the smaller id. Up to `block` queries
    are broadcast in one pass over base; a task keeps the best k of its rows for each query, and only those are shuffled.
    More queries, whatever their number, are cut into blocks as base is, each side read once, and blocks of queries are
    compared in the tasks with those blocks of base that may hold nearer vectors than the nearest blocks do. Vectors are
    of one length; rows with null ids or vectors take no part.
    """
    usable = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    base = usable(base).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = usable(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    got = asked.limit(block + 1).collect()
    if len(got) > block:
        found = _by_blocks(asked, base, k, max(64, min(SIDE, (1 << 19) // len(got[0]["v"]))))
    elif got:
        ids = np.array([r[0] for r in got], dtype=np.int64)
        held = base.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r[1] for r in got], dtype=np.float64))))
        found = base.mapInArrow(_search(held, k), "query long, neighbour long, similarity double")
    else:
        return base.sparkSession.createDataFrame([], "query long, neighbour long, similarity double, place int")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _kept(queries: np.ndarray, left: np.ndarray, part: np.ndarray, right: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k so far of each query, with the rows `part` counted in."""
    scores = np.round(left @ right.T, DIGITS)
    scores[queries[:, None] == part[None, :]] = -np.inf
    ids = np.concatenate([ids, np.broadcast_to(part, scores.shape)], axis=1)
    sims = np.concatenate([sims, scores], axis=1)
    order = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _search(held, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, matrix = held.value
        ids, sims = np.zeros((len(queries), 0), dtype=np.int64), np.zeros((len(queries), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("id").to_numpy()
            for at in range(0, len(own), 4096):
                ids, sims = _kept(queries, matrix, own[at : at + 4096], _unit(_rows(batch.column("v").slice(at, 4096))), ids, sims, k)
        row, col = np.nonzero(np.isfinite(sims))
        yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(ids[row, col]), pa.array(sims[row, col])], names=["query", "neighbour", "similarity"])

    return search


# Many queries: blocks of queries against blocks of rows.


def _cells(count: int) -> int:
    """Sign bits that split `count` vectors into cells of about SIDE."""
    return max(0, min(16, (count // SIDE).bit_length()))


def _planes(dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng(1).standard_normal((dims, bits))


def _with_cell(bits: int):
    """Vectors as bytes of unit doubles, with the cell that the signs of random projections put them into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _unit(_rows(part.column("v")))
                cells = ((unit @ _planes(unit.shape[1], bits) > 0) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(unit), dtype=np.int64)
                data = pa.array([row.tobytes() for row in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cells, pa.int64()), data], names=["id", "cell", "unit"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block: ids, matrix, the direction of its mean and the widest angle of a vector to that."""
    ids = table.column("id").to_numpy()
    matrix = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
    centre = _unit(matrix.mean(axis=0, keepdims=True))[0]
    radius = float(np.arccos(np.clip(matrix @ centre, -1, 1)).max()) + SLACK
    if not centre.any():
        radius = np.pi
    one = {"block": table.column("block")[0], "n": len(ids), "ids": ids.astype(np.int64).tobytes(), "matrix": matrix.tobytes(), "centre": centre.tobytes(), "radius": radius}
    return pa.Table.from_pylist([one], pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())]))


def blocks(rows: DataFrame, side: int) -> DataFrame:
    """Rows (id, v) in blocks of at most `side`: near vectors come together, and a crowded cell is cut by id."""
    units = rows.mapInArrow(_with_cell(_cells(rows.count())), "id long, cell long, unit binary")
    placed = ranked(units, ["cell"], [F.col("id")])
    cut = placed.select("id", "unit", (F.col("cell") * (1 << 40) + F.expr(f"place div {side}")).alias("block"))
    return stored(cut.groupBy("block").applyInArrow(_packed, "block long, n long, ids binary, matrix binary, centre binary, radius double"), "blocks")


def _angles(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a query block and the blocks of a chunk: least angle between any two of their vectors, and of the centres."""
    for batch in pairs:
        out = []
        for row in batch.to_pylist():
            centres = np.frombuffer(b"".join(b["centre"] for b in row["held"])).reshape(len(row["held"]), -1)
            apart = np.arccos(np.clip(centres @ np.frombuffer(row["centre"]), -1, 1))
            out += [(row["asked"], b["block"], b["n"], float(a), float(a - row["radius"] - b["radius"])) for b, a in zip(row["held"], apart, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["asked", "block", "n", "apart", "least"])


def _pairs(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(asked, block, n, apart, least) of all pairs of blocks, from summaries in chunks of blocks."""
    chunks = max(1, -(-held.count() // CHUNK))
    summaries = held.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"), F.struct("block", "n", "centre", "radius").alias("held"))
    listed = summaries.groupBy("chunk").agg(F.collect_list("held").alias("held"))
    every = asked.select(F.col("block").alias("asked"), "centre", "radius", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    return every.join(listed, "chunk").select("asked", "centre", "radius", "held").mapInArrow(_angles, "asked long, block long, n long, apart double, least double")


def _best(k: int):
    """Query blocks, each followed by the blocks that it is compared with; the best k of each query go on."""

    def emit(queries: np.ndarray, ids: np.ndarray, sims: np.ndarray, asked: int) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(sims))
        columns = [pa.array(np.full(len(row), asked)), pa.array(queries[row]), pa.array(ids[row, col]), pa.array(sims[row, col])]
        return pa.RecordBatch.from_arrays(columns, names=["asked", "query", "neighbour", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            for place in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[place].as_buffer(), dtype=np.int64)
                matrix = np.frombuffer(batch.column("matrix")[place].as_buffer(), dtype=np.float64).reshape(len(ids), -1)
                if not batch.column("kind")[place].as_py():
                    if asked is not None:
                        yield emit(queries, found, sims, asked)
                    asked, queries, left = batch.column("asked")[place].as_py(), ids.copy(), matrix.copy()
                    found, sims = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
                    continue
                if matrix.shape[1] == left.shape[1]:
                    found, sims = _kept(queries, left, ids, matrix, found, sims, k)
        if asked is not None:
            yield emit(queries, found, sims, asked)

    return run


def _compared(pairs: DataFrame, asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(asked, query, neighbour, similarity): the best k of each query within its pairs of blocks, those of one task.

    A query block's pairs are dealt to as many tasks as there are to spare; each gets the query block once and streams
    the others.
    """
    n = partitions(asked.sparkSession)
    spread = max(1, -(-n // max(1, asked.count())))
    salt = F.pmod(F.xxhash64("block"), F.lit(spread)).alias("salt")
    right = pairs.select("asked", "block").join(held.select("block", "ids", "matrix"), "block").select("asked", salt, F.lit(1).alias("kind"), "ids", "matrix")
    left = asked.select(F.col("block").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), "ids", "matrix")
    dealt = left.unionByName(right).repartition(n, "asked", "salt").sortWithinPartitions("asked", "salt", "kind")
    return dealt.mapInArrow(_best(k), "asked long, query long, neighbour long, similarity double")


def _by_blocks(asked: DataFrame, base: DataFrame, k: int, side: int) -> DataFrame:
    """Hits of all queries, exact: the nearest blocks give each query block a bound, and only blocks whose vectors may be
    nearer than that are compared with it."""
    left, right = blocks(asked, side), blocks(base, side)
    pairs = stored(_pairs(left, right), "pairs")
    near = Window.partitionBy("asked").orderBy("apart", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = Window.partitionBy("asked").orderBy("apart", "block")
    closest = pairs.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 2).withColumn("so_far", F.sum("n").over(near)).where(F.col("so_far") - F.col("n") <= k)
    first = stored(_compared(closest, left, right, k), "first")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    kth = first.withColumn("place", F.row_number().over(best)).groupBy("asked", "query").agg(F.max(F.when(F.col("place") == k, F.col("similarity"))).alias("kth"))
    bounds = kth.groupBy("asked").agg(F.when(F.count("kth") == F.count("*"), F.min("kth")).alias("kth"), F.count("*").alias("queries"))
    known = left.select(F.col("block").alias("asked"), F.col("n").alias("size")).join(bounds, "asked", "left")
    known = known.select("asked", F.when(F.col("queries") == F.col("size"), F.col("kth")).alias("kth"))
    may = F.cos(F.greatest(F.col("least"), F.lit(0.0))) >= F.col("kth") - 10.0**-DIGITS
    rest = pairs.join(known, "asked").where(F.coalesce(may, F.lit(True))).join(closest.select("asked", "block"), ["asked", "block"], "left_anti")
    more = _compared(rest, left, right, k)
    return first.union(more).select("query", "neighbour", "similarity")


def neighbour_lists(hits: DataFrame, names: DataFrame, name: str = "author", id_col: str = "vec_id") -> DataFrame:
    """(query, candidates): for each query its neighbours as structs (similarity, name), the nearest first."""
    named = hits.join(names.select(F.col(id_col).alias("neighbour"), F.col(name).cast("string").alias("name")), "neighbour")
    ordered = F.array_sort(F.collect_list(F.struct("place", "similarity", "name")))
    return named.groupBy("query").agg(F.transform(ordered, lambda s: F.struct(s["similarity"].alias("similarity"), s["name"].alias("name"))).alias("candidates"))
