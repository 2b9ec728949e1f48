"""Trees, names and predicates on literal cases."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import intervals, levels, maps, naming, traversal
from weftgraph.sources import projection


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_path_predicates(spark):
    got = one(spark, paths.is_test(F.col("x")), "test/a", "src/tests/b", "a/__tests__/b", "a.spec.ts", "a_test.go", "x/test_a.py", "e2e/a", "latest/a", "contest.ts", None)
    assert got == [True] * 7 + [False, False, None]
    assert one(spark, paths.is_handler(F.col("x")), "handleIt", "ItHandler", "it_handler", "ithandler", "rehandle") == [True, True, True, False, False]
    assert one(spark, paths.is_public(F.col("x"), F.lit("go")), "fn go\n  pub fn go", "pub fn stop\nfn go", "export go", None) == [True, False, True, False]
    got = one(spark, paths.file_box(F.col("x"), "src/*.ts| docs/ |**x|Main"), "src/a.ts", "src/b/a.ts", "a/docs/b", "docs/c", "a/b/x", "a/main.go", "none")
    assert got == [True, False, True, True, True, True, False]


def test_common_folder(spark):
    df = spark.createDataFrame([("a", "x/y/1"), ("a", "x/y/2"), ("a", "x/yz/3"), ("b", "p/q"), ("c", "q"), ("c", "r/s"), ("d", "u/v/w"), ("d", "u/v/w/z")], "k string, path string")
    got = {r.k: r.f for r in df.groupBy("k").agg(paths.common_folder(F.col("path")).alias("f")).collect()}
    assert got == {"a": "x", "b": "p", "c": "root", "d": "u/v"}
    assert one(spark, F.array_join(paths.folders_of(F.col("x")), " "), "a/b/c", "a") == ["a a/b", ""]


def test_names_that_repeat(spark):
    df = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, line long")
    assert sorted(r.stable for r in naming.stable_keys(df, "key", ["line"]).collect()) == ["k", "k#2", "m"]
    assert sorted(r.iri for r in naming.entity_iris(df, "key", "line", ["line"]).collect()) == ["k", "k~2", "m"]
    assert sorted(r.unique_label for r in naming.unique_labels(df, "key", ["line"]).collect()) == ["k", "k 2", "m"]
    at = spark.createDataFrame([(0,), (1759622400,)], "s long").select(naming.date_time(F.col("s"))).collect()
    assert [r[0] for r in at] == ["1970-01-01T00:00:00Z", "2025-10-05T00:00:00Z"]


def test_climb_near_and_loops(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")
    got = {r.id: (r.top, r.levels) for r in maps.climb(spark.createDataFrame([("d",), ("a",), ("z",)], "id string"), tree, F.col("at") == "a").collect()}
    assert got == {"d": ("a", 3), "a": ("a", 0)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "x")], "src string, dst string")
    assert maps.reaches(edges, "a", "d") and not maps.reaches(edges, "d", "a") and not maps.reaches(edges, "nowhere", "a")


def brute_classes(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n and b != n} for n in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    out = {}
    for n in nodes:
        own = {m for m in nodes if m in reach[n] and n in reach[m]} | {n}
        if len(own) > 1:
            out[n] = min(own)
    return out


def test_strong_components_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    for n, m in ((8, 10), (30, 36), (30, 60)):
        pairs = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)}
        got = {r.id: r.component for r in levels.strong_components(spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()}
        assert got == brute_classes(pairs)
    ring = [(f"n{i:03d}", f"n{(i + 1) % 12:03d}") for i in range(12)]
    with pytest.raises(RuntimeError):
        levels.strong_components(spark.createDataFrame(ring, "src string, dst string"), most_rounds=3)


def test_reach_counts_a_node_once_even_in_loops(spark):
    rows = [("e", "a"), ("e", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("f", "e"), ("f", "c")]
    edges = spark.createDataFrame([(a, b, 1.0, 1, 2) for a, b in rows], "src string, dst string, weight double, line long, tier int")
    assert {r.entry: r.reach for r in traversal.flow_reach(edges).collect()} == {"f": 4}


def test_reach_by_arrays_equals_reach_by_pairs(spark):
    import random

    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randrange(40):02d}", f"n{rng.randrange(8, 40):02d}") for _ in range(120)})
    after = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    want = {}
    for entry in (a for a in after if len(after[a]) > 1 and all(b != a for _, b in pairs)):
        met, front = set(), {entry}
        for _ in range(4):
            front = set().union(*(after.get(n, set()) for n in front))
            met |= front
        want[entry] = len(met)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert len(want) > 3
    for most in (10_000, 60, 0):  # arrays alone, both ways, pairs alone
        assert {r.entry: r.reach for r in traversal.flow_reach(edges, most=most).collect()} == want


def test_numbered_nodes_keep_their_names(spark):
    rows = spark.createDataFrame([(4 * k + kind,) for k in (0, 7, -3) for kind in range(3)], "n long")
    assert [r.id for r in rows.select(projection.named("n").alias("id")).collect()] == [f"{kind}:{k}" for k in (0, 7, -3) for kind in ("order", "part", "supplier")]


def test_binned_intervals_find_each_pair_once(spark):
    import datetime as d

    day = lambda n: d.datetime(2024, 1, 1) + d.timedelta(days=n)
    spans = spark.createDataFrame([("k", 1, day(0), day(100)), ("k", 2, day(50), day(55)), ("k", 3, day(70), day(40)), ("j", 4, day(0), day(9))], "k string, id long, a timestamp_ntz, b timestamp_ntz")
    ranges = spark.createDataFrame([("k", 9, day(30), day(90)), ("k", 8, day(54), day(54))], "k string, range_id long, ra timestamp_ntz, rb timestamp_ntz")
    got = sorted((r.id, r.range_id) for r in intervals.overlapping(spans, ranges, "k").collect())
    assert got == [(1, 8), (1, 9), (2, 8), (2, 9), (3, 9)]
    points = spark.createDataFrame([("k", day(54)), ("k", day(99)), ("j", day(30))], "k string, point timestamp_ntz")
    got = {(r.k, r.point): r.owner for r in intervals.innermost(points, spans, "k").collect()}
    assert got == {("k", day(54)): 2, ("k", day(99)): 1, ("j", day(30)): None}
