"""Communities against a walk through the nodes one by one; new cycles against a plain search; orders against the plain rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import communities, planning


def walk(edges, most=24):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label, rounds = {n: n for n in near}, 0
    for rounds in range(1, most + 1):
        moved = False
        for n in sorted(near):
            score = {label[n]: 0.05}
            for m, w in near[n]:
                score[label[m]] = score.get(label[m], 0) + w
            best = min(score, key=lambda x: (-round(score[x], 6), x))
            moved |= best != label[n]
            label[n] = best
        if not moved:
            break
    return label, rounds


@pytest.mark.parametrize(("seed", "nodes", "arcs"), [(1, 14, 22), (2, 9, 20)])
def test_communities_equal_a_sequential_walk(spark, seed, nodes, arcs):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}", rng.choice([0.3, 0.6, 1.0, 1.2])) for _ in range(arcs)]
    got = communities.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()
    want, rounds = walk(edges)
    assert {r.id: r.label for r in got} == want
    assert {r.rounds for r in got} == {rounds}


def test_edges_weigh_by_kind(spark):
    kinds = spark.createDataFrame([("CALLS", 0.1), ("CALLS", 2.0), ("CONTAINS", 9.0), ("IMPORTS", 9.0), ("X", 9.0)], "kind string, weight double")
    assert [r[0] for r in kinds.select(communities.edge_weight(F.col("kind"), F.col("weight"))).collect()] == [0.25, 2.0, 1.2, 0.6, 0.3]


def plain_cycles(edges):
    nodes, to = {n for e in edges for n in e}, {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(n):
        seen, left = set(), [n]
        while left:
            for m in to.get(left.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    left.append(m)
        return seen

    far = {n: reach(n) for n in nodes}
    return {frozenset([n, *(m for m in far[n] if n in far[m])]) for n in nodes if any(m != n and n in far[m] for m in far[n])}


@pytest.mark.parametrize("seed", [5])
def test_new_cycles_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    pick = lambda k: [(f"m{rng.randrange(16):02}", f"m{rng.randrange(16):02}") for _ in range(k)]
    before = pick(14) + [("x1", "x2"), ("x2", "x1"), ("y1", "y2"), ("y2", "y3")]
    now = before + pick(4) + [("y3", "y1")]
    df = lambda e: spark.createDataFrame(e, "src string, dst string")
    got = communities.new_cycles(df(now), df(before)).collect()
    want = plain_cycles(now) - plain_cycles(before)
    assert {(r.component, r.members) for r in got} == {(min(c), len(c)) for c in want}
    assert ("y1", 3) in {(r.component, r.members) for r in got} and "x1" not in {r.component for r in got}
    for r in got:
        own = next(c for c in want if min(c) == r.component)
        ways, found = [(r.component,)], []
        while not found:
            ways = [(*w, b) for w in ways for a, b in set(now) if a == w[-1] and b in own and b != a]
            found = [w for w in ways if w[-1] == r.component]
        assert tuple(r.loop) == min(found)


def test_the_same_classes_are_not_new(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert communities.new_cycles(df, df).count() == 0
    assert [tuple(r) for r in communities.new_cycles(df, df.where("false")).collect()] == [("a", 2, ["a", "b", "a"])]


def plain_order(rows):
    left, done = {i: set(d) - {i} for i, d in rows}, []
    while left:
        free = min((i for i, d in left.items() if d <= set(done)), default=None)
        done.append(min(left) if free is None else free)
        del left[done[-1]]
    return done


def test_orders_equal_the_plain_rule_and_thousands_of_slices_are_fast(spark):
    rng = random.Random(9)
    for _ in range(4):
        rows = [(f"s{k}", [f"s{rng.randrange(34)}" for _ in range(rng.randrange(3))]) for k in range(30)]
        got = planning.in_order(spark.createDataFrame(rows, "id string, deps array<string>"))
        assert [r.id for r in got.orderBy("step").collect()] == plain_order(rows)
    many = spark.range(10_000).select(F.format_string("s%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, F.array(F.format_string("s%05d", F.col("id") + 1))).otherwise(F.array().cast("array<string>")).alias("deps"))
    began = time.time()
    assert planning.in_order(many).count() == 10_000
    assert time.time() - began < 10
