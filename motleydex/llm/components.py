"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import persist_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's greater neighbours point to the least of all; small star: its lesser ones and itself do."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = edges.unionByName(back) if large else edges  # edges point from the greater to the lesser
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
    near = sides.hint("merge").join(least, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("to").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("to").alias("b")).unionByName(least.select("a", F.col("to").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(a, b): every node of the links (a, b) with the least node of its component, that node itself left out.

    Rounds are repeated until the links no longer change, told by their number and a sum of hashes; their number
    grows with the logarithm of the longest chain. Each round is stored, so lost executors cost one round.
    """
    edges = persist_table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        edges = persist_table(_stars(persist_table(_stars(edges, True), "links"), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(now) == state:
            return edges
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
