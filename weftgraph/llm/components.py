"""Distributed connected components by alternating large and small stars; DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of an undirected edge: the smallest node it is joined to.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node
    around it (Kiveris et al., 2014); over ``most_rounds`` of them raise an error. Minima are aggregated before the shuffle and joined back, so
    a node with very many edges is never gathered in one task; its edges are split by skew-join
    handling. Rounds grow with the logarithm of the longest chain. Null ends and loops are ignored.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for done in range(most_rounds + 1):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        if done == most_rounds:
            raise RuntimeError(f"components are still joined after {most_rounds} rounds")
        before = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(linked.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
