"""Two snapshots of a graph compared by stable keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import dealt


def diff_edges(base: DataFrame, head: DataFrame) -> DataFrame:
    """``src, dst, status``: added, removed, changed (weight or tier) or same; one full outer join."""
    b = base.select("src", "dst", F.col("weight").alias("bw"), F.col("tier").alias("bt"))
    h = head.select("src", "dst", F.col("weight").alias("hw"), F.col("tier").alias("ht"))
    status = F.when(F.col("bw").isNull(), "added").when(F.col("hw").isNull(), "removed").when((F.col("bw") != F.col("hw")) | (F.col("bt") != F.col("ht")), "changed").otherwise("same")
    return b.join(h, ["src", "dst"], "full").select("src", "dst", status.alias("status"))


def diff_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """``id, status``: added, removed, modified (another body) or same; a node's body is its summed weight.

    Both bodies are sums of one grouping; nodes without an id are never the same.
    """
    none = F.lit(None).cast("double")
    ends = [edges.select(F.col(end).alias("id"), b.alias("b"), h.alias("h"), F.lit(side).alias("side")) for side, edges, b, h in ((0, base, F.col("weight"), none), (1, head, none, F.col("weight"))) for end in ("src", "dst")]
    both = reduce(DataFrame.union, ends).groupBy("id", F.when(F.col("id").isNull(), F.col("side")).alias("side")).agg(F.sum("b").alias("b"), F.sum("h").alias("h"))
    return both.select("id", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "modified").otherwise("same").alias("status"))


def recheck(base: DataFrame, head: DataFrame, parts: int | None = None) -> DataFrame:
    """``caller, callee``: unchanged callers of modified nodes; ``parts`` as from :func:`~weftgraph.session.parts_of`."""
    nodes = diff_nodes(base, head)
    same = nodes.where("status = 'same'").select(F.col("id").alias("src"))
    modified = nodes.where("status = 'modified'").select(F.col("id").alias("dst"))
    known = dealt(head.select("src", "dst"), parts, "src").join(dealt(same, parts, "src"), "src")
    return dealt(known, parts, "dst").join(dealt(modified, parts, "dst"), "dst").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


def dangling(base: DataFrame, head: DataFrame, floor: int = 1) -> DataFrame:
    """``caller, callee``: calls of the base, no mere guesses, to a node that is gone, from one that is still there."""
    nodes = diff_nodes(base, head)
    gone = nodes.where("status = 'removed'").select(F.col("id").alias("dst"))
    there = nodes.where("status <> 'removed'").select(F.col("id").alias("src"))
    return base.where(F.col("tier") >= floor).join(gone, "dst").join(there, "src").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


def focus(base: DataFrame, head: DataFrame) -> DataFrame:
    """``id`` of changed nodes, ends of changed edges, and all one hop from these."""
    edges, nodes = diff_edges(base, head), diff_nodes(base, head)
    moved = edges.where("status <> 'same'")
    core = nodes.where("status <> 'same'").select("id").union(moved.select("src")).union(moved.select("dst")).distinct()
    out = edges.join(core.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    into = edges.join(core.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"))
    return core.union(out).union(into).distinct()
