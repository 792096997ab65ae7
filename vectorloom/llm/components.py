"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(pairs: DataFrame) -> DataFrame:
    """Give each node's neighbours the least of them all (pairs: node a, neighbour b)."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (src, dst); root is the least node of its component.

    Large and small stars alternate until the edges no longer change: each round is two grouped
    minimums and joins, and no node's neighbours ever meet in one row. Loops and repeated edges do no
    harm; an empty table gives an empty result.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    e, before = materialize(e, "edges"), None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        s = _stars(large)
        small = s.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(s.select("a", F.col("m").alias("b"))).distinct()
        seen = Observation()  # counts the edges while they are written, without a job of its own
        old, e = e, materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")), "edges")
        discard(old)
        now = seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
