"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: columns a, b of one orderable type; direction, order and repeats don't matter. Returns node, component (a node that is
    its component's smallest is not listed). Edges only shrink towards stars, hubs are min-aggregated before they shuffle, and each
    round is written to the shared folder, so nothing is gathered on the driver but a count and a checksum. What edges are joined with is written
    first: both sides of the join are plain exchanges then, and Spark splits the edges of a hub over several tasks.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        sign = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        state = cut(_small_star(_large_star(state)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
