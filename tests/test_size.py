"""What Spark is asked to do as tables grow: sides that grow are shuffled, and small files of many rows are dealt out."""

import re

from pyspark.sql import functions as F

from weftgraph import session
from weftgraph.operators import diff, ledger, levels, linking, maps, packs, resolution, traversal, triples
from weftgraph.session import cut
from weftgraph.sources import projection


def planned(spark, run):
    """The plans of all that a run executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    return [store.executionsList(k, 1).apply(0).physicalPlanDescription() for k in range(before, store.executionsCount())]


def kept(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_definitions_do_not_go_through_the_driver(spark, tmp_path):
    defs = kept(spark.range(9).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.concat(F.lit("p"), F.col("id")).alias("path"), F.lit("f").alias("family")), tmp_path / "d")
    sites = kept(spark.range(9).select(F.col("id").alias("site"), F.lit("-").alias("caller"), F.lit("n").alias("name"), F.concat(F.lit("p"), F.col("id")).alias("path"), F.lit("f").alias("family")), tmp_path / "s")
    none = cut(spark.createDataFrame([], "path string, target string"))
    plans = planned(spark, lambda: linking.link_names(sites, defs, none, []).collect())
    # imports may be sent, as they have a key of their own
    assert plans and not [p for p in plans if re.search(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[name", p)]


def test_files_do_not_go_through_the_driver(spark, tmp_path):
    files = kept(spark.range(9).select(F.concat(F.lit("a/p"), F.col("id"), F.lit(".py")).alias("path")), tmp_path / "f")
    asked = kept(spark.range(9).select(F.col("id").alias("site"), F.lit("m.py").alias("path"), F.lit("python").alias("lang"), F.concat(F.lit("p"), F.col("id")).alias("raw")), tmp_path / "i")
    plans = planned(spark, lambda: resolution.import_files(asked, files).collect())
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p.split("Initial Plan")[-1]]


def test_sources_written_from_a_small_file_are_dealt_out(spark):
    from weftgraph.plans import flow_queries, source_queries

    least = 4 * spark.sparkContext.defaultParallelism
    assert flow_queries.declared_models(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * least
    assert source_queries._web(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= least


def test_edges_stay_where_they_are_while_a_frontier_is_small(spark, tmp_path, monkeypatch):
    edges = kept(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "a")], "src string, dst string"), tmp_path / "e")
    plans = planned(spark, lambda: maps.reaches(edges, "a", "x"))
    assert plans and not [p for p in plans if "hashpartitioning(src" in p]
    for most in (maps.MOST_SENT, 0):
        monkeypatch.setattr(maps, "MOST_SENT", most)
        assert maps.reaches(edges, "x", "c") and not maps.reaches(edges, "a", "x")


def test_candidates_keep_the_best_relation(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "b"), ("a", "c"), ("c", "s"), ("b", "s")], "src string, dst string")
    tree = spark.createDataFrame([("t", "s"), ("a", "s")], "parent string, child string")
    out = packs.candidates(edges, tree, spark.createDataFrame([("s",)], "seed string"))
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: (r.why, r.score) for r in out.collect()} == {"s": ("seed", 1.0), "a": ("uses", 0.72), "b": ("uses", 0.72), "c": ("used by", 0.6), "t": ("container", 0.55)}


def test_lines_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 500)
    lines = session.read_table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert projection.calls(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 2 * -(-lines // 500)


def test_calls_that_stand_once_are_not_made_distinct_again(spark):
    edges, tree = spark.createDataFrame([("a:1", "b:1"), ("a:2", "b:1")], "src string, dst string"), spark.createDataFrame([("c:1", "a:1"), ("c:1", "a:1")], "parent string, child string")
    called = triples.pattern(triples.state(edges, tree, once=True), "?s", "calls", "?o")
    assert "Aggregate" not in called._jdf.queryExecution().optimizedPlan().toString()
    want = {("a:1", "calls", "b:1"), ("a:2", "calls", "b:1"), ("c:1", "contains", "a:1"), *((f"{k}:{n}", "a", k) for k, n in (("a", 1), ("a", 2), ("b", 1), ("c", 1)))}
    for state in (triples.state(edges, tree, once=True), triples.state(edges.union(edges), tree)):
        assert state.count() == len(want) and {tuple(r) for r in state.collect()} == want


def test_commits_meet_what_they_touched_where_it_lies(spark):
    rows = [("1", "a", 1), ("1", "b", 1), ("2", "a", 2), ("2", "b", 2), ("3", "b", 3)]
    commits = spark.createDataFrame(rows, "sha string, path string, ts int")
    touched = commits.select("sha", "path")
    assert [tuple(r) for r in levels.co_change(commits, "a", touched=touched).collect()] == [("b", 2)] == [tuple(r) for r in levels.co_change(commits, "a").collect()]


def test_bodies_of_both_snapshots_are_one_grouping(spark):
    edges = lambda *rows: spark.createDataFrame(rows, "src string, dst string, weight double, tier int")
    base, head = edges(("a", "b", 1.0, 2), ("a", "c", 1.0, 2), (None, "c", 1.0, 2)), edges(("a", "b", 2.0, 2), ("d", "c", 2.0, 2), (None, "a", 0.0, 2))
    nodes = diff.diff_nodes(base, head)
    assert "Join" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, nodes.collect()), key=str) == [("a", "same"), ("b", "modified"), ("c", "same"), ("d", "added"), (None, "added"), (None, "removed")]
    assert {tuple(r) for parts in (None, 3) for r in diff.recheck(base, head, parts).collect()} == {("a", "b")}


def test_nodes_and_containment_are_dealt_out(spark):
    edges, tree = spark.createDataFrame([("a:1", "b:1"), ("a:2", "b:1")], "src string, dst string").coalesce(1), spark.createDataFrame([("c:1", "a:1"), ("c:1", "a:1"), ("c:1", None)], "parent string, child string")
    dealt = triples.state(edges, tree, once=True, parts=7)
    assert dealt.rdd.getNumPartitions() == 1 + 7 + 7
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, triples.state(edges, tree).collect()), key=str)


def test_no_row_of_a_summary_stands_for_one_hit(spark):
    edges = spark.createDataFrame([("p:1", "s:1", 2), ("p:2", "s:1", 0), ("p:2", "s:2", 1), ("p:3", "s:2", 1), ("p:4", "s:3", 2)], "src string, dst string, tier int")
    seeds = spark.createDataFrame([(f"s:{k}", f"s:{k}") for k in (1, 2, 3)], "seed string, id string")
    groups = spark.createDataFrame([("p:1", "x"), ("p:2", "x"), ("p:3", "y"), ("p:3", "z")], "id string, group string")
    hits = traversal.impact(edges, seeds, True, 1, parts=7)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, traversal.impact(edges, seeds, True, 2).collect()))
    out = traversal.impact_summary(hits, groups)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("s:1", 2, 2, 1, 0, 1, 1, "low"), ("s:2", 2, 2, 0, 2, 0, 3, "low"), ("s:3", 1, 1, 0, 0, 1, 0, "low")]


def test_calls_are_lifted_as_numbers_and_by_parts(spark):
    sf = "/root/testdata/sf0.001"
    calls = projection.tiered_calls(spark, sf, 5)
    assert dict(calls.dtypes)["src"] == "bigint" and calls.rdd.getNumPartitions() == 5
    want = {(r.src, r.dst, r.tier) for r in projection.calls(spark, sf).collect()}
    assert {tuple(r) for r in calls.select(projection.named("src"), projection.named("dst"), "tier").collect()} == want and calls.count() == len(want)
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 3, 2), (3, 1, 1)], "src long, dst long, tier int")
    members = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, owner string")
    lifted = levels.lift(edges.repartition(5, "src"), members, 5)
    assert lifted.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, lifted.collect())) == [("x", "y", 2, 1), ("y", "x", 1, 1)] == sorted(map(tuple, levels.lift(edges, members).collect()))


def test_no_row_of_a_changelog_stands_for_one_touch(spark):
    seats = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", False), (2, "a", True), (3, "a", False)], "run long, seat string, passed boolean")
    files = spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (1, "b", "q"), (2, "a", "p"), (2, "a", "r"), (2, "a", None), (3, "a", "s"), (4, "a", "p"), (1, "a", "t")], "run long, seat string, path string")
    domains = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "x"), ("t", None), ("t", "outside"), ("u", "z")], "path string, domain string")
    out = ledger.changelog(seats, files, domains)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("outside", 2, 2), ("x", 1, 2), ("y", 1, 2)] == sorted(map(tuple, ledger.changelog(seats, files, domains, 7).collect()))
    # without seats a run is done when one of its seats passed
    assert sorted(map(tuple, ledger.changelog(seats, files.drop("seat"), domains, 7).collect())) == [("outside", 2, 2), ("x", 2, 2), ("y", 1, 2)]


def test_a_changelog_is_dealt_out_by_the_number_of_lines(spark, monkeypatch):
    from weftgraph.plans import record_queries

    monkeypatch.setattr(session, "PART_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    parts = -(-session.read_table(spark, sf, "lineitem").count() // 500)
    plan = record_queries.run_changelog(spark, sf)._jdf.queryExecution().executedPlan().toString()
    shuffled = re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan)
    assert "BroadcastExchange" not in plan and len(shuffled) == 8
    assert {n for keys, n in shuffled if not re.fullmatch(r"domain#\d+", keys)} == {str(parts)}


def test_scopes_and_definitions_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    from weftgraph.plans import source_queries

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    for module in (resolution, source_queries):
        monkeypatch.setattr(module, "stored", seen)
    out = source_queries.typed_calls(spark, "/root/testdata/sf0.001")
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 4 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_candidates_are_made_where_they_are_told_apart(spark):
    rows = [("s", "a"), ("s", "b"), ("s", None), ("a", "b"), ("a", "c"), ("a", "c"), ("c", "s"), ("b", "s"), ("x", "y"), ("y", None)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    tree, seeds = spark.createDataFrame([("t", "s"), ("a", "s"), ("t", "q")], "parent string, child string"), spark.createDataFrame([("s",), ("s",), ("y",), ("z",)], "seed string")
    want = {("s", "s", "seed"), ("s", "a", "uses"), ("s", "b", "uses"), ("s", None, "uses"), ("s", "c", "used by"), ("s", "t", "container"), ("y", "y", "seed"), ("y", None, "uses"), ("y", "x", "used by"), ("z", "z", "seed")}
    for parts in (None, 3):
        out = packs.around(edges, edges, edges, tree, seeds, parts=parts)
        assert sorted(((r.seed, r.id, r.why) for r in out.collect()), key=str) == sorted(want, key=str)
    few = packs.around(edges, edges, edges, tree, seeds, 1, text=lambda c: F.translate(c, "bc", "cb"), parts=3)
    assert {r.id: r.why for r in few.where("seed = 's'").collect()}["c"] == "used by"


def test_a_pack_shuffles_numbers_once_by_used_node_and_once_by_seed(spark, monkeypatch):
    from weftgraph.plans import composite_queries

    monkeypatch.setattr(session, "PART_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    parts = -(-session.read_table(spark, sf, "lineitem").count() // 500)
    for query in (composite_queries.context_candidates, composite_queries.context_pack):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        shuffled = re.findall(r"hashpartitioning\((.*?)#\d+L, (\d+)\)", plan)
        assert sorted(shuffled) == sorted([("used", str(parts))] * 2 + [("seed", str(packs.FINER * parts))] * 2) and plan.count("Exchange") == 4


def test_a_pack_of_rows_that_are_dealt_is_the_same(spark):
    rows = spark.sql("select id % 7 as seed, concat('n', id) as id, if(id % 3 = 0, '2nd-order', 'uses') as why, (id % 5) / 5D as score, id % 11 as span, if(id = 9, null, 30 + id % 50) as cost, 28 + id % 9 as short from range(300)")
    told = packs.budget_pack(rows, 400)
    both = [sorted(map(tuple, told.collect())), sorted(map(tuple, packs.budget_pack(rows.repartition(3, "seed"), 400, dealt_by_seed=True).collect()))]
    assert both[0] == both[1] and len(both[0]) > 7 and dict(told.dtypes)["seed"] == "bigint"


def test_what_a_name_means_is_found_once_for_all_its_sites(spark, monkeypatch):
    kept_frames = []

    def seen(df):
        kept_frames.append(cut(df))
        return kept_frames[-1]

    monkeypatch.setattr(linking, "stored", seen)
    sites = spark.createDataFrame([(f"s{k}", "-", "n", "p", "f") for k in range(50)], "site string, caller string, name string, path string, family string")
    defs = spark.createDataFrame([(f"d{k}", "n", "p", "f") for k in range(3)], "id string, name string, path string, family string")
    out = linking.link_names(sites, defs, spark.createDataFrame([], "path string, target string"), [])
    assert {(r.site, r.id, r.weight, r.tier) for r in out.collect()} == {(f"s{k}", f"d{i}", 0.333333, 0) for k in range(50) for i in range(3)}
    assert [df.count() for df in kept_frames if "id" in df.columns] == [6]  # three in their own file, the same three as guesses


def test_sites_of_several_rows_or_without_a_path_are_linked_as_one_by_one(spark):
    import itertools
    import random

    rng = random.Random(7)
    one = lambda *many: rng.choice(many)
    sites = [(f"s{rng.randrange(30)}", one("c", "d1", "d2"), one("n", "m", "hot", None), one("p", "q", "r", None), one("f", "g")) for _ in range(45)]
    defs = [(f"d{k}", one("n", "m", "hot", None), one("p", "q", "r", "t", None), one("f", "g")) for k in range(16)]
    imports = [("p", "q"), ("p", "q"), ("p", "t"), ("q", "r"), ("r", None), (None, "p")]
    found = []
    for (site, caller, name, path, family), (id_, n, at, fam) in itertools.product(sites, defs):
        if name is None or (name, family) != (n, fam):
            continue
        k = sum(d[1] == name and d[3] == family for d in defs)
        ranks = [1] * (path is not None and path == at) + ([2] * (path is not None and at is not None and (path, at) in imports) + [3] * (k <= 3) if name != "hot" else [])
        found += [(site, caller, id_, rank) for rank in ranks]
    best = {s: min(r for x, _, _, r in found if x == s) for s, *_ in found}
    n = {s: sum(x == s and r == best[s] for x, _, _, r in found) for s in best}
    want = [(s, i, round(1 / n[s], 6), 0 if n[s] > 1 or r == 3 else 1) for s, c, i, r in found if r == best[s] and i != c]
    frames = spark.createDataFrame(sites, "site string, caller string, name string, path string, family string"), spark.createDataFrame(defs, "id string, name string, path string, family string"), spark.createDataFrame(imports, "path string, target string")
    assert sorted(map(tuple, linking.link_names(*frames, ["hot"]).collect())) == sorted(want) and len(want) > 20


def test_sites_are_numbers_until_they_are_linked(spark, monkeypatch):
    from weftgraph.plans import policy_queries

    kept_types = []

    def seen(df):
        kept_types.append(dict(df.dtypes))
        return cut(df)

    monkeypatch.setattr(linking, "stored", seen)
    policy_queries.name_linker_priority(spark, "/root/testdata/sf0.001")
    assert [t for t in kept_types if "caller" in t] == [{"caller": "bigint", "word": "bigint", "path": "int", "nowhere": "boolean", "rows": "bigint"}]


def test_a_key_of_two_parts_stands_for_two_names(spark, tmp_path):
    from weftgraph.plans import policy_queries

    tables = {
        "part": spark.createDataFrame([(1, "a", "Brand#1", "T", 1), (1, "b", "Brand#1", "T", 1), (2, "b", "Brand#1", "T", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": spark.createDataFrame([(5, 0)], "s_suppkey long, s_nationkey int"), "nation": spark.createDataFrame([(0, 3)], "n_nationkey int, n_regionkey int"),
        "lineitem": spark.createDataFrame([(5, 1)], "l_suppkey long, l_partkey long"),
    }
    for name, rows in tables.items():
        kept(rows, tmp_path / f"{name}.parquet")
    out = policy_queries.name_linker_priority(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("5/a/T 1", "part:1", 1.0, 1), ("5/b/T 1", "part:1", 0.5, 0), ("5/b/T 1", "part:2", 0.5, 0)]


def test_an_item_without_a_size_is_taken_as_its_signature(spark):
    rows = [("s", "a", "uses", 0.7, 40, 34, 30), ("s", None, "uses", 0.7, None, None, 39), ("s", None, "2nd-order", 0.3, None, None, 39)]
    told = packs.budget_pack(spark.createDataFrame(rows, "seed string, id string, why string, score double, span long, cost long, short long"), 100, dealt_by_seed=True)
    assert [tuple(r) for r in told.collect()] == [("s", "a", "uses", 1, False, 34), ("s", None, "uses", 2, True, 73)]
