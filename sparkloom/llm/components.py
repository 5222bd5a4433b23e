"""Connected components of an edge table by alternating large-star and small-star.

Both steps send each node to the smallest node it knows. Minima are aggregated before
the shuffle and joined back, so a hub's edges are never collected; the join's hub side
is one row, which adaptive execution can split. Each round is written to the shared
folder, as few files as its rows need, so neither lineage nor driver memory grows; the
driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common

#: Edges that a task writes.
EDGES_A_FILE = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.

    ``edges`` has long columns a and b; direction, repeats and loops don't matter.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = common.cut(pairs, "edges")
    before = _state(pairs)
    while before[0]:
        pairs = common.cut(_small_star(_large_star(pairs)).coalesce(-(-before[0] // EDGES_A_FILE)), "edges")
        now = _state(pairs)
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(pairs.select("b", "b").distinct())
