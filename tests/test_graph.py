"""Literal graphs with known answers."""

import pytest

from weftgraph.operators import diff, levels, traversal

EDGE = "src string, dst string, weight double, tier int"


def graph(spark, *edges):
    return spark.createDataFrame([(a, b, 1.0, t) for a, b, t in edges], EDGE)


def test_diamond_takes_the_better_of_two_parents_of_a_level(spark):
    e = graph(spark, ("a", "b", 0), ("a", "c", 2), ("b", "d", 2), ("c", "d", 1))
    got = {tuple(r) for r in traversal.impact(e, traversal.one_seed(e, "a"), upstream=False).select("id", "depth", "tier").collect()}
    assert got == {("b", 1, 0), ("c", 1, 2), ("d", 2, 1)}


def test_cycle_ends_and_floor_is_monotone(spark):
    e = graph(spark, ("1", "2", 2), ("2", "3", 1), ("3", "1", 2), ("3", "4", 0))
    ids = [{r.id for r in traversal.impact(e, traversal.one_seed(e, "1"), False, 9, f).collect()} for f in (0, 1, 2)]
    assert ids[0] == {"2", "3", "4"} and ids[2] <= ids[1] <= ids[0]


def test_shortest_path_breaks_ties_by_the_smallest(spark):
    e = graph(spark, ("a", "c", 2), ("a", "b", 2), ("b", "d", 2), ("c", "d", 2))
    assert [r.id for r in traversal.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "b", "d"]
    assert traversal.shortest_path(e, "d", "a").count() == 0


def test_boundary_and_inside_cover_all_touching_edges(spark):
    e = graph(spark, ("a", "b", 2), ("b", "c", 2), ("d", "a", 2), ("x", "y", 2))
    inner, cross = traversal.isolate(e, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert inner.count() == 1 and {(r.outside, r.direction) for r in cross.collect()} == {("c", "out"), ("d", "in")}


def test_diff_with_itself_is_all_same_and_mirrors(spark):
    a, b = graph(spark, ("a", "b", 2)), graph(spark, ("a", "b", 1), ("b", "c", 2))
    assert {r.status for r in diff.diff_edges(a, a).collect()} == {"same"}
    assert sorted(r.status for r in diff.diff_edges(a, b).collect()) == ["added", "changed"]
    assert sorted(r.status for r in diff.diff_edges(b, a).collect()) == ["changed", "removed"]


def test_barbell_has_two_communities_and_a_cycle_one_component(spark):
    e = graph(spark, *[(x, y, 2) for c in ("abc", "xyz") for x in c for y in c if x < y], ("c", "x", 2)).withColumn("weight", levels.F.lit(1.0))
    labels = {r.id: r.label for r in levels.label_propagation(e, 4).collect()}
    assert len({labels[x] for x in "ab"}) == 1 and len({labels[x] for x in "yz"}) == 1
    scc = {r.id: r.component for r in levels.strong_components(graph(spark, ("a", "b", 2), ("b", "a", 2), ("b", "c", 2))).collect()}
    assert scc == {"a": "a", "b": "a"}


@pytest.mark.parametrize("name", ["impact_min_tier", "coupling_index", "co_change", "graph_diff_nodes"])
def test_query_matches_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    want = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in entry.queries()[name](spark, d).select(*names).collect()) == want
