"""Communities by label propagation in the order of ids, and loops of modules with one witness each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.levels import strong_components
from weftgraph.session import cut

# What an edge weighs by kind, how much a node holds on to its label, and how many rounds there are.
KINDS, OTHER, LEAST_CALL, SELF, MOST_ROUNDS = {"CONTAINS": 1.2, "IMPORTS": 0.6}, 0.3, 0.25, 0.05, 24


def edge_weight(kind: Column, weight: Column) -> Column:
    out = F.when(kind == "CALLS", F.greatest(weight.cast("double"), F.lit(LEAST_CALL)))
    for name, value in KINDS.items():
        out = out.when(kind == name, F.lit(value))
    return out.otherwise(F.lit(OTHER))


def turns(arcs: DataFrame, most: int) -> DataFrame:
    """``id, turn`` of the nodes of ``src, dst`` (both ways): one more than the latest turn of the neighbours before it by id.

    Neighbours never share a turn, and who goes through the turns sees the nodes before it done and those behind it not: what going
    through all nodes one by one by id would show.
    """
    ahead = cut(arcs.where("src < dst").select("src", "dst").distinct())
    known = cut(arcs.select(F.col("src").alias("id")).distinct().withColumn("turn", F.lit(0)))
    front = known
    for _ in range(most + 1):
        told = ahead.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("turn") + 1).alias("told"))
        new = cut(known.join(told, "id", "left").select("id", F.greatest("turn", "told").alias("turn"), (F.col("told") > F.col("turn")).alias("moved")))
        known, front = new.select("id", "turn"), new.where("moved").select("id", "turn")
        if front.isEmpty():
            return known
    raise RuntimeError(f"a chain of over {most} neighbours with rising ids")


def communities(edges: DataFrame, most_rounds: int = MOST_ROUNDS, self_weight: float = SELF, most_turns: int = 1000) -> DataFrame:
    """``id, label, rounds``: the communities of undirected ``src, dst, weight``; a label is the id of a node.

    In each round every node, by id, takes the label that weighs most among its neighbours, its own with ``self_weight`` more, ties to the
    smallest, until a round moves none or there were ``most_rounds``. Nodes of a turn (:func:`turns`) aren't neighbours and move
    together; only nodes with a neighbour that moved are looked at again. Weights are compared to six digits, so the
    order of sums doesn't matter. A graph needs as many turns as its longest chain of neighbours with rising ids; over ``most_turns`` raise.
    Loops on one node count twice for it; nodes without edge don't appear.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    arcs = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    state = turns(arcs, most_turns).select("id", "turn", F.col("id").alias("label"), F.lit(True).alias("open"), F.lit(False).alias("moved"))
    rounds = 0
    for rounds in range(1, most_rounds + 1):
        moved, at = False, -1
        while True:
            # the next turn with a node to look at; nodes of turns gone by wait for the next round
            told = state.agg(F.min(F.when(F.col("open") & (F.col("turn") > at), F.col("turn"))), F.max("moved")).first()
            moved, at = moved or bool(told[1]), told[0]
            if at is None:
                break
            todo = state.where(F.col("open") & (F.col("turn") == at)).select("id", "label")
            near = arcs.join(todo.select(F.col("id").alias("src")), "src").join(state.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
            votes = near.union(todo.select("id", "label", F.lit(self_weight))).groupBy("id", "label").agg(F.round(F.sum("w"), 6).alias("w"))
            new = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("best")).join(todo, "id").where("best <> label").select("id", "best")
            # a node that moved tells its neighbours to look again; its own move gives it no reason to
            told_by = new.unionByName(arcs.join(new.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.lit(None).cast("string").alias("best")))
            news = told_by.groupBy("id").agg(F.max("best").alias("best"), F.max(F.col("best").isNull()).alias("touched"))
            opened = F.coalesce("touched", F.lit(False)) | (F.col("open") & (F.col("turn") != at))
            state = cut(state.join(news, "id", "left").select("id", "turn", F.coalesce("best", "label").alias("label"), opened.alias("open"), F.col("best").isNotNull().alias("moved")))
        state = state.withColumn("moved", F.lit(False))
        if not moved:
            break
    return state.select("id", "label", F.lit(rounds).alias("rounds"))


def witness_loops(edges: DataFrame, components: DataFrame, most_steps: int = 10_000) -> DataFrame:
    """``component, loop``: the shortest loop of each component through its smallest node, the first of several; ``loop`` begins and ends with it.

    All components are walked side by side, a join a step; of the ways to a node only the first goes on. Loops of over ``most_steps`` raise.
    """
    at = components.select("id", "component")
    inside = edges.select("src", "dst").where("src <> dst").distinct().join(at.withColumnRenamed("id", "src"), "src").join(at.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst")
    inside = cut(inside.where("component = c").select("component", "src", "dst"))
    front = cut(at.groupBy("component").agg(F.min("id").alias("id")).withColumn("way", F.array("id")))
    met, done = front.select("component", "id"), None
    for _ in range(most_steps):
        onward = inside.join(front.withColumnRenamed("id", "src"), ["component", "src"]).select("component", F.col("dst").alias("id"), F.concat("way", F.array("dst")).alias("way"))
        step = cut(onward.groupBy("component", "id").agg(F.min("way").alias("way")))
        back = step.where(F.col("id") == F.get("way", F.lit(0))).select("component", F.col("way").alias("loop"))
        done = back if done is None else done.union(back)
        front = cut(step.join(met, ["component", "id"], "left_anti").join(back.select("component"), "component", "left_anti"))
        if front.isEmpty():
            return done
        met = cut(met.union(front.select("component", "id")))
    raise RuntimeError(f"a loop of over {most_steps} steps")


def new_cycles(now: DataFrame, before: DataFrame) -> DataFrame:
    """``component, members, loop`` of the classes of mutual reachability of ``now`` (``src, dst``) that ``before`` doesn't have as they are.

    Classes are held against each other by a digest of their sorted members; a class is named by its smallest. ``members`` says how many, ``loop`` is one shortest
    witness through the smallest.
    """
    def classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = cut(strong_components(edges))
        # order-free digest: two sums over hashes of all members, their number and the smallest
        mark = lambda k: F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)"))
        return own, own.groupBy("component").agg(F.count(F.lit(1)).alias("members"), mark(1).alias("m1"), mark(2).alias("m2"))

    own, sets = classes(now)
    new = cut(sets.join(classes(before)[1], ["component", "members", "m1", "m2"], "left_anti").select("component", "members"))
    kept = own.join(new.select("component"), "component", "left_semi")
    return new.join(witness_loops(now, kept), "component").select("component", "members", "loop")
