"""Chains on sparse graphs: PageRank and Neumann series over an edge table.

A chain's edges are dealt once, by source and block of targets, and stay where they lie; a
source with many targets has many blocks. Each round sends every node's number to its
blocks, adds products up by target in tasks and then in the cluster, and writes the new
numbers. What goes to the driver is a sum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources import tables

#: Targets of one source in a block.
BLOCK = 50_000


class Chain:
    """Row-stochastic chain of weighted edges (a, b, w): each source's weights over their
    sum. Edges of no positive weight and null ends are left out, repeated edges add up;
    nodes without edges out of them are dangling. ``nodes`` may name further ones."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, block: int = BLOCK):
        used = edges.where("a is not null and b is not null and w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))
        used = tables.cut(used, "edges")
        outs = used.groupBy("a").agg(F.sum("w").alias("out"), F.count("*").alias("n"))
        ends = used.select(F.col("a").alias("node")).union(used.select("b"))
        if nodes is not None:
            ends = ends.union(nodes.select(nodes.columns[0]).where(F.col(nodes.columns[0]).isNotNull()))
        outs = outs.select(F.col("a").alias("node"), "out", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        self.nodes = tables.cut(ends.distinct().join(outs, "node", "left"), "nodes")
        self.size = self.nodes.count()
        shares = used.join(self.nodes.withColumnRenamed("node", "a"), "a")
        shares = shares.select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), "b", (F.col("w") / F.col("out")).alias("p"))
        self.edges = tables.cut(shares.repartition("a", "block").sortWithinPartitions("a", "block"), "shares")

    def start(self, total: float = 1.0) -> DataFrame:
        """(node, blocks, x): ``total`` spread evenly."""
        return self.nodes.select("node", "blocks", F.lit(total / max(self.size, 1)).alias("x"))

    def step(self, numbers: DataFrame, absorb: bool) -> tuple[DataFrame, float]:
        """(node, moved) of nodes that something moves to, and the mass of dangling nodes
        (0 unless ``absorb``), which is spread evenly: the stochastic completion."""
        sent = numbers.where("blocks is not null").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "x")
        moved = self.edges.join(sent, ["a", "block"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("moved"))
        lost = 0.0
        if absorb:
            lost = numbers.where("blocks is null").agg(F.sum("x")).first()[0] or 0.0
        return moved, lost


def pagerank(chain: Chain, damping: float = 0.85, rounds: int = 50, tol: float = 0.0) -> DataFrame:
    """(node, rank): stationary vector of the damped chain after ``rounds`` rounds, or as
    soon as a round moves at most ``tol`` in all. No edges and no nodes give no rows."""
    now = tables.cut(chain.start(), "rank")
    for _ in range(rounds if chain.size else 0):
        moved, lost = chain.step(now, absorb=True)
        base = (1 - damping) / chain.size + damping * lost / chain.size
        new = now.join(moved, "node", "left").select("node", "blocks", (F.lit(base) + damping * F.coalesce("moved", F.lit(0.0))).alias("x"), F.col("x").alias("last"))
        now = tables.cut(new, "rank")
        if tol and (now.agg(F.sum(F.abs(F.col("x") - F.col("last")))).first()[0] or 0.0) <= tol:
            break
    return now.select("node", F.col("x").alias("rank"))


def neumann(chain: Chain, damping: float = 0.85, rounds: int = 50, absorb: bool = False) -> DataFrame:
    """(node, total): the first ``rounds`` + 1 terms of (I - damping P')^-1 applied to an even
    start, that is the discounted visits of a walk. Walks end in dangling nodes unless they
    ``absorb`` them."""
    now = tables.cut(chain.start().withColumn("total", F.col("x")), "terms")
    for _ in range(rounds if chain.size else 0):
        moved, lost = chain.step(now, absorb)
        term = damping * (F.coalesce("moved", F.lit(0.0)) + lost / chain.size)
        now = tables.cut(now.join(moved, "node", "left").select("node", "blocks", term.alias("x"), (F.col("total") + term).alias("total")), "terms")
    return now.select("node", "total")
