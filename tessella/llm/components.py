"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 100


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them or the node itself: those above the node (large star), or those below and the node (small star)."""
    near = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter("a != b").distinct()


def connected(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) for each node of edges (a, b), both long and not null; the component is its smallest node.

    Each round goes to a staged table, and two numbers about it come to the driver. Self-loops add nothing.
    """
    now = common.stage(edges.filter("a != b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        new = common.stage(_star(_star(now, large=True), large=False), "edges")
        common.unstage(now)
        now = new
        at = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if at == before:
            break
        before = at
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
