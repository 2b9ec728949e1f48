"""Roll-ups of a graph and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import cut, dealt, wide


def lift(edges: DataFrame, member_of: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges between owners: ``src, dst, n, tier``; ``member_of`` has ``id, owner``. Own loops drop out.

    With ``parts`` edges lie in so many parts by ``src`` already; they are dealt by ``dst`` and then by owners, and meet members where these are sent.
    """
    a = member_of.select(F.col("id").alias("src"), F.col("owner").alias("a"))
    b = member_of.select(F.col("id").alias("dst"), F.col("owner").alias("b"))
    if parts:
        a, b = wide(dealt(a, parts, "src")), wide(dealt(b, parts, "dst"))
    both = dealt(edges.join(a, "src").select("dst", "a", "tier"), parts, "dst").join(b, "dst").where("a <> b").select("a", "b", "tier")
    return dealt(both, parts, "a", "b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.max("tier").alias("tier"))


def matrix(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def two_way_loops(m: DataFrame) -> DataFrame:
    """``a, b, forth, back, weaker`` of pairs that depend on each other, a < b."""
    back = m.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("n").alias("back"))
    return m.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("forth")).join(back, ["a", "b"]).withColumn("weaker", F.least("forth", "back"))


def coupling_index(m: DataFrame) -> DataFrame:
    """Sum of in-degrees over (modules that have one times the largest)."""
    degree = m.groupBy("dst").agg(F.count_distinct("src").alias("d"))
    return degree.agg(F.round(F.sum("d") / (F.count(F.lit(1)) * F.max("d")), 6).alias("coupling"))


def instability(m: DataFrame) -> DataFrame:
    """``id, fan_in, fan_out, instability`` by distinct peers."""
    out = m.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("fan_out"))
    into = m.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("fan_in"))
    both = out.join(into, "id", "full").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``; a loop counts once."""
    ends = edges.select(F.col("src").alias("id")).union(edges.where("src <> dst").select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hotspots(edges: DataFrame, churn: DataFrame, k: int) -> DataFrame:
    """Top k by churn times ln(degree + 2); ``churn`` has ``id, churn``."""
    score = F.round(F.col("churn") * F.log(F.col("degree") + F.lit(2.0)), 6)
    return churn.join(degrees(edges), "id").withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def co_change(commits: DataFrame, path: str, newest: int = 150, most_files: int = 40, least: int = 2, touched: DataFrame | None = None) -> DataFrame:
    """``path, n``: what changed with a path in its newest commits, large commits aside.

    ``commits`` has ``sha, path, ts``; ``touched`` has ``sha, path`` of the same commits where these are known without a join, so that the few commits
    meet them where they lie.
    """
    with_path = commits.where(F.col("path") == path).select("sha", "ts").distinct().orderBy(F.desc("ts"), F.desc("sha")).limit(newest)
    files = (commits if touched is None else touched).join(F.broadcast(with_path.select("sha")), "sha").select("sha", "path").distinct()
    small = files.groupBy("sha").count().where(F.col("count") <= most_files).select("sha")
    return files.join(small, "sha").where(F.col("path") != path).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def god_nodes(fans: DataFrame, least_size: int) -> DataFrame:
    """Nodes whose fan is above the 95th percentile and whose size above a bound; ``id, fan, size``."""
    p95 = fans.agg(F.expr("percentile(cast(fan as double), 0.95)").alias("p95"))
    return fans.join(F.broadcast(p95)).where((F.col("fan") > F.col("p95")) & (F.col("size") > least_size)).drop("p95")


def uncalled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest; counts are made before the window."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def label_propagation(edges: DataFrame, rounds: int, self_weight: float = 0.05) -> DataFrame:
    """``id, label`` after some synchronous rounds over undirected ``src, dst, weight``; ties to the smallest label."""
    arcs = cut(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    labels = arcs.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = arcs.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label", "w")
        votes = votes.union(labels.select("id", "label", F.lit(self_weight)))
        sums = votes.groupBy("id", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        labels = cut(sums.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("neg"), "label")).alias("best")).select("id", "best.label"))
    return labels


def strong_components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``id, component``: nodes on a cycle with the smallest node of their class of mutual reachability.

    Colouring: every node takes the smallest node that reaches it; those of a colour that reach its first node back are
    its class and go, and only edges within a colour are left for the next round. Nothing is ever paired with all that it
    reaches: a step costs one join of the edges. Nodes without an edge in or out are trimmed first. Beyond
    ``most_rounds`` steps of one kind it raises.
    """
    left = _trimmed(cut(edges.where("src <> dst").select("src", "dst").distinct()))
    classes = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        colours = _first_reaching(left, most_rounds)
        a, b = (colours.select(F.col("id").alias(end), F.col("colour").alias(f"c_{end}")) for end in ("src", "dst"))
        left = cut(left.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("colour")))
        front = members = cut(colours.where("id = colour"))
        for _ in range(most_rounds):
            back = left.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = cut(back.join(members.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            members = cut(members.union(front))
        else:
            raise RuntimeError(f"a cycle of over {most_rounds} steps")
        classes = members if classes is None else classes.union(members)
        gone = members.select("id")
        left = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = _trimmed(cut(left.select("src", "dst")))
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    if classes is None:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    several = classes.groupBy("colour").count().where("count > 1").select("colour")
    return classes.join(several, "colour").select("id", F.col("colour").alias("component"))


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Without edges whose source nothing calls or whose target calls nothing, some rounds deep."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return cut(edges)


def _first_reaching(edges: DataFrame, most_rounds: int) -> DataFrame:
    """``id, colour``: the smallest node that reaches each, itself included; only what changed is passed on."""
    colours = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.col("id").alias("colour")))
    front = colours
    for _ in range(most_rounds):
        told = edges.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("told"))
        new = cut(colours.join(told, "id", "left").select("id", F.least("colour", "told").alias("colour"), (F.col("told") < F.col("colour")).alias("moved")))
        front, colours = new.where("moved").select("id", "colour"), new.select("id", "colour")
        if front.isEmpty():
            return colours
    raise RuntimeError(f"colours still move after {most_rounds} steps")


def fan_percentile(fans: DataFrame, share: float) -> DataFrame:
    """One row: the interpolated percentile of ``fan`` and how many nodes are above it."""
    p = fans.agg(F.expr(f"percentile(cast(fan as double), {share})").alias("p"))
    return fans.join(F.broadcast(p)).groupBy("p").agg(F.count_if(F.col("fan") > F.col("p")).alias("above"))


def export_top(edges: DataFrame, k: int) -> DataFrame:
    """``src, dst, weight`` among the k best connected nodes, with whether any node was left out."""
    d = degrees(edges)
    top = d.orderBy(F.desc("degree"), "id").limit(k).select("id")
    cut_off = d.agg((F.count(F.lit(1)) > k).alias("truncated"))
    inner = edges.join(top.withColumnRenamed("id", "src"), "src").join(top.withColumnRenamed("id", "dst"), "dst")
    return inner.select("src", "dst", "weight").join(F.broadcast(cut_off))
