"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import in_tasks, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of the edges."""
    n, mix = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return n, mix or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``; the label is the smallest node.

    Null nodes are dropped, loops and repeated edges count once; an empty table gives
    an empty result. A step deals the edges out twice, by the node whose smallest neighbour
    is asked for: that minimum and its edges meet where they lie, and no node's neighbours
    are gathered. Every step is written once, by as many tasks as its edges ask for. The
    number of steps grows with the logarithm of the longest chain. ``edges`` is read twice.
    """
    now = edges.where("a is not null and b is not null").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a <> b").distinct()
    now = stored(in_tasks(now, edges.count()), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        # Large star: neighbours greater than a node move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(low.hint("merge"), "a").select(moved.alias("e")).select("e.*").where("a <> b").distinct()
        now = stored(in_tasks(small, state[0]), "edges")
    # Stars are left: no centre has a smaller neighbour.
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
