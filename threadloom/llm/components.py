"""Connected components of an edge table, by minimum labels with path halving (alternating star contractions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import drop_table, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node among itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them. Edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
    joined = edges.join(least, F.col("b") == F.col("u")).select("a", "b", "m")
    return joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("u").alias("y"))).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node it reaches.

    Edges are undirected; loops and repeats are allowed. Each round is written to the shared folder, so lineage stays
    short and lost executors cost one round at most. Minimum aggregations combine on the map side and joins on a hot
    node can be split, so a star of any size is fine. Rounds grow with the logarithm of the longest path.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    shape, before = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first(), None
    while True:
        then = materialize(_small_star(_large_star(now)), "cc")
        drop_table(now)
        now, after = then, shape(then)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
