"""Connected components by alternating star contraction, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table

#: Edges of one node that one task handles, about; a node with more is dealt out.
NODE_EDGES = 100_000
#: Most nodes that are dealt out: each has over 1 / BUSY_NODES of all edges, so there are no more.
BUSY_NODES = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(rows: DataFrame, total: int, node_edges: int) -> DataFrame:
    """(a, b, m): rows (a, b) with the smallest b of their a.  The rows of a node with many are dealt to several tasks."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    bound = max(node_edges, total // BUSY_NODES)
    if total <= bound:
        return rows.join(least.drop("n"), "a")
    least = least.select("a", "m", F.when(F.col("n") > bound, F.ceil(F.col("n") / node_edges)).otherwise(1).cast("int").alias("parts"))
    # At most total / bound <= BUSY_NODES rows, a proven bound.
    busy = F.broadcast(least.where("parts > 1").select(F.col("a").alias("busy"), "parts"))
    dealt = rows.join(busy, rows.a == F.col("busy"), "left").select("a", "b", F.expr("int(pmod(xxhash64(b), coalesce(parts, 1)))").alias("part"))
    copies = least.select("a", "m", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    return dealt.join(copies, ["a", "part"]).select("a", "b", "m")


def _large_star(edges: DataFrame, total: int, node_edges: int) -> DataFrame:
    """Each node hangs its larger neighbours on its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(both, 2 * total, node_edges).withColumn("m", F.least("a", "m"))
    return found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int, node_edges: int) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest of them (edges run from larger to smaller)."""
    found = _with_least(edges, total, node_edges)
    return found.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, node_edges: int = NODE_EDGES) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has long columns ``a`` and ``b`` in any order; loops, repeats and nulls are ignored.  No edges give
    no rows.  The number of rounds grows with the logarithm of the longest path; each round is written as a table in
    the shared folder, and the round before it goes.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = table(edges)
    before = _state(edges)
    while before[0]:
        stars, between = table(_large_star(edges, before[0], node_edges))
        edges, next_path = table(_small_star(stars, before[0], node_edges))
        drop_table(spark, path)
        drop_table(spark, between)
        path = next_path
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
