"""Connected components of a table of links, by alternating stars.

Each round hangs the larger neighbours of every node, then the smaller ones, on its smallest
neighbour; links get fewer and trees flatter until nothing changes, in about log(n) rounds.
Rounds are written in the shared folder; the driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import forget, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over links (a, b) with a > b."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    both = edges.join(low, "a")
    if large:
        out = both.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = both.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")
                                             ).unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node of its component."""
    edges = settle(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                   .filter("a != b").distinct(), "links")
    state = None
    while True:
        before, edges = edges, settle(_star(_star(edges, True), False), "links")
        forget(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
