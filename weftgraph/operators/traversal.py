"""Breadth-first operators: one join, one aggregation and one anti-join a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut, dealt, stored, wide


def neighbours(edges: DataFrame, node: str, out: bool = True) -> DataFrame:
    """One hop: ``id, weight, tier``."""
    here, there = ("src", "dst") if out else ("dst", "src")
    return edges.where(F.col(here) == node).select(F.col(there).alias("id"), "weight", "tier")


def impact(edges: DataFrame, seeds: DataFrame, upstream: bool = True, max_depth: int = 3, floor: int = 0, parts: int | None = None) -> DataFrame:
    """``seed, id, depth, tier`` of all that seeds reach, each seed for itself.

    ``seeds`` has ``seed, id`` at depth 0. Depth is the first level that reaches a node; its tier is
    the best over its parents of that level of the weaker of edge and parent. Every level joins the
    frontier only, and what was seen before is dropped by an anti-join, so a level costs what its
    own edges cost. Edges above the floor are cut once, dealt by the node that a level joins on, so that
    a level shuffles its frontier only; a single level reads them once, where they are. Each level is checkpointed, as plans would double otherwise.
    With ``parts`` what a level reaches is dealt into so many parts before it is grouped.
    """
    here, there = ("dst", "src") if upstream else ("src", "dst")
    arcs = edges.where(F.col("tier") >= floor).select(F.col(here).alias("id"), F.col(there).alias("next"), F.col("tier").alias("edge_tier"))
    arcs = cut(arcs.repartition("id")) if max_depth > 1 else arcs
    front = seeds.select("seed", "id", F.lit(0).alias("depth"), F.lit(2).alias("tier")).distinct()
    levels, seen = [], front.select("seed", "id")
    for depth in range(1, max_depth + 1):
        step = front.join(arcs, "id").select("seed", F.col("next").alias("id"), F.least("tier", "edge_tier").alias("tier"))
        step = dealt(step, parts, "seed", "id").groupBy("seed", "id").agg(F.max("tier").alias("tier"))
        front = cut(step.join(seen, ["seed", "id"], "left_anti").select("seed", "id", F.lit(depth).alias("depth"), F.col("tier").cast("int").alias("tier")))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("seed", "id"))
    out = levels[0] if levels else front.where("false")
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def one_seed(edges: DataFrame, root: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(root, root)], "seed string, id string")


# From how many hits, direct hits, groups, touched and affected nodes on a risk is high or medium.
HIGH_HITS, HIGH_GROUPS, MEDIUM_DIRECT, MEDIUM_HITS = 40, 5, 5, 12
HIGH_AFFECTED, MEDIUM_TOUCHED, MEDIUM_AFFECTED = 40, 10, 10


def risk_of_hits(hits: Column, direct: Column, groups: Column) -> Column:
    """Risk of one root by how much it reaches."""
    return (
        F.when((hits >= HIGH_HITS) | (groups >= HIGH_GROUPS), "high").when((direct >= MEDIUM_DIRECT) | (hits >= MEDIUM_HITS), "medium").when(hits == 0, "none").otherwise("low")
    )


def risk_of_change(touched: Column, affected: Column) -> Column:
    """Risk of a set of changes."""
    return F.when(affected >= HIGH_AFFECTED, "high").when((touched >= MEDIUM_TOUCHED) | (affected >= MEDIUM_AFFECTED), "medium").when((touched == 0) & (affected == 0), "none").otherwise("low")


def impact_summary(hits: DataFrame, groups: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a seed: hits, direct hits, tiers, distinct groups and risk. ``hits`` has a seed and an id once, ``groups`` has ``id, group``.

    Hits are counted without their groups, and a seed's groups are made distinct as they come, so that no row stands for one hit;
    with ``parts`` hits meet groups in so many parts.
    """
    met = dealt(hits.select("seed", "id"), parts, "id").join(wide(dealt(groups, parts, "id")), "id").select("seed", "group").distinct().groupBy("seed").agg(F.count("group").alias("groups"))
    rows = hits.groupBy("seed").agg(
        F.count("id").alias("hits"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        *[F.count_if(F.col("tier") == k).alias(name) for k, name in enumerate(("guessed", "inferred", "resolved"))],
    ).join(met, "seed", "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    return rows.withColumn("risk", risk_of_hits(F.col("hits"), F.col("direct"), F.col("groups")))


def shortest_path(edges: DataFrame, a: str, b: str, max_depth: int = 6, floor: int = 0) -> DataFrame:
    """``step, id`` of the shortest directed path, ties to the smallest predecessor; empty if there is none."""
    reach = impact(edges, one_seed(edges, a), upstream=False, max_depth=max_depth, floor=floor)
    reach = cut(reach.select("id", "depth").union(edges.sparkSession.createDataFrame([(a, 0)], "id string, depth int")))
    found = reach.where(F.col("id") == b).first()
    steps: list[tuple[int, str]] = []
    if found:
        node, depth = b, found["depth"]
        steps.append((depth, node))
        arcs = edges.where(F.col("tier") >= floor)
        while depth:  # at most max_depth small jobs
            depth -= 1
            before = arcs.where(F.col("dst") == node).join(reach.where(F.col("depth") == depth), F.col("src") == F.col("id"))
            node = before.agg(F.min("src")).first()[0]
            steps.append((depth, node))
    return edges.sparkSession.createDataFrame(sorted(steps), "step int, id string")


def entry_points(edges: DataFrame, least_calls: int = 2) -> DataFrame:
    """``id`` of nodes that nothing calls and that call at least so many others."""
    busy = edges.groupBy("src").count().where(F.col("count") >= least_calls).select(F.col("src").alias("id"))
    return busy.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def flow_reach(edges: DataFrame, max_depth: int = 4, most: int = 10_000) -> DataFrame:
    """``entry, reach``: how many nodes each entry point reaches in so many steps; edges are distinct, ids of any type.

    Only the arcs that a walk from an entry can take are kept, a ring for each step. From the last ring back, the nodes that one
    reaches are gathered as one array from those of the nodes that it calls, so an entry meets an array for each of its calls rather than a
    row for each walk. Arrays are made where at most ``most`` walks begin, which is counted first; entries with more go by pairs.
    """
    arcs = stored(edges.select("src", "dst").where("src is not null and dst is not null"))
    rings = [stored(arcs.join(entry_points(arcs).select(F.col("id").alias("src")), "src", "left_semi"))]
    for _ in range(1, max_depth):
        ring = stored(arcs.join(rings[-1].select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if ring.isEmpty():
            break
        rings.append(ring)
    walks = sets = None
    for ring in reversed(rings):
        if walks is None:
            onward = ring.select("src", F.lit(1).cast("long").alias("n"))
        else:
            onward = ring.join(walks.withColumnRenamed("src", "dst"), "dst", "left").select("src", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
        counts = onward.groupBy("src").agg(F.sum("n").alias("n"))
        below, walks = sets, stored(counts)
        few = ring.join(walks.where(F.col("n") > most).select("src"), "src", "left_anti")
        met = F.array("dst")
        if below is not None:
            few = few.join(below.withColumnRenamed("src", "dst"), "dst", "left")
            met = F.concat(met, F.coalesce("met", F.array().cast(below.schema["met"].dataType)))
        # dealt by source first: gathered in part before, the arrays would be sorted twice
        few = few.select("src", met.alias("met")).repartition("src")
        sets = few.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    light = sets.select(F.col("src").alias("entry"), F.size("met").cast("long").alias("reach"))
    heavy = walks.where(F.col("n") > most).select(F.col("src").alias("entry"))
    return light if heavy.isEmpty() else light.union(_reach_by_pairs(arcs, heavy, max_depth))


def _reach_by_pairs(arcs: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """``entry, reach`` of ``entry``; a row for each entry and node of a level, so none is too large.

    A walk may meet a node twice, so levels are made without a look at those before and pairs are made distinct once, at the end.
    """
    levels = [stored(starts.join(arcs, F.col("entry") == F.col("src")).select("entry", F.col("dst").alias("id")))]
    for _ in range(1, max_depth):
        step = levels[-1].join(arcs, F.col("id") == F.col("src")).select("entry", F.col("dst").alias("id"))
        step = stored(step.distinct())
        if step.isEmpty():
            break
        levels.append(step)
    met = levels[0]
    for level in levels[1:]:
        met = met.union(level)
    return met.distinct().groupBy("entry").agg(F.count(F.lit(1)).alias("reach"))


def context(edges: DataFrame, tree: DataFrame, node: str) -> DataFrame:
    """``relation, id, tier`` of all around a node; ``tree`` has ``parent, child``."""
    out = neighbours(edges, node, True).select(F.lit("callee").alias("relation"), "id", "tier")
    back = neighbours(edges, node, False).select(F.lit("caller").alias("relation"), "id", "tier")
    up = tree.where(F.col("child") == node).select(F.lit("container").alias("relation"), F.col("parent").alias("id"), F.lit(2).alias("tier"))
    down = tree.where(F.col("parent") == node).select(F.lit("child").alias("relation"), F.col("child").alias("id"), F.lit(2).alias("tier"))
    return out.union(back).union(up).union(down)


def isolate(edges: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges within a set of ``id``, and its boundary ``outside, direction, n, members``."""
    a = inside.select(F.col("id").alias("src"), F.lit(True).alias("src_in"))
    b = inside.select(F.col("id").alias("dst"), F.lit(True).alias("dst_in"))
    flagged = edges.join(a, "src", "left").join(b, "dst", "left").where("src_in or dst_in")
    inner = flagged.where("src_in and dst_in").select("src", "dst", "weight", "tier")
    cross = flagged.where("src_in is null or dst_in is null")
    cross = cross.select(
        F.when(F.col("src_in"), F.col("dst")).otherwise(F.col("src")).alias("outside"),
        F.when(F.col("src_in"), F.lit("out")).otherwise(F.lit("in")).alias("direction"),
        F.when(F.col("src_in"), F.col("src")).otherwise(F.col("dst")).alias("member"),
    )
    return inner, cross.groupBy("outside", "direction").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("member").alias("members"))
