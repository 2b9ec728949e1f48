"""Rules, routes, links, memory and ledger on literal rows."""

import pytest

from weftgraph.operators import ledger, linking, memory, policy, ranking, routes, search, triples
from weftgraph.operators.policy import F, Rule


def test_strictest_rule_wins_and_the_first_among_equals(spark):
    rules = [Rule("a", policy.LOCKED, ("src",)), Rule("b", policy.LOCKED, ("**/*.py",)), Rule("c", policy.HIDDEN, symbols=("secret",))]
    nodes = spark.createDataFrame([("src/x.py", "f"), ("lib/y.py", None), ("srcs/z.c", "g"), ("lib/y.c", "secret"), (None, None)], "path string, symbol string")
    got = {(r.path, r.symbol): (r.level, r.rule) for r in policy.verdicts(nodes, rules).collect()}
    assert got == {("src/x.py", "f"): (2, "a"), ("lib/y.py", None): (2, "b"), ("srcs/z.c", "g"): (0, None), ("lib/y.c", "secret"): (3, "c"), (None, None): (0, None)}
    assert policy.visible(nodes, rules).count() == 4


@pytest.mark.parametrize(
    "glob, path, fits",
    [("src", "src/a/b", True), ("src/", "src", True), ("src", "src2", False), ("*.{md,rst}", "a/b.md", True), ("a?c", "abc", True), ("**/t.py", "t.py", True), ("a.b", "axb", False)],
)
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(policy.glob_regex(glob), path)) is fits


def test_bodies_are_compared_as_multisets(spark):
    row = "path string, symbol string, body string"
    rules = [Rule("all", policy.LOCKED, ("p",))]
    base = spark.createDataFrame([("p", "f", "1"), ("p", "f", "1"), ("p", "g", "x"), ("q", "f", "1")], row)
    head = spark.createDataFrame([("p", "f", "1"), ("p", "g", "x"), ("q", "f", "2")], row)
    assert [(r.path, r.symbol) for r in policy.changed_fenced(base, head, rules).collect()] == [("p", "f")]


def test_routes_prefer_equality_then_the_last_declared(spark):
    made = spark.createDataFrame([(1, "/a/:param", 1), (2, "/a/b", 2), (3, "/:param/c", 3), (4, "/a/:param", 4)], "route_id int, path string, declared int")
    asked = spark.createDataFrame([(1, "/a/b"), (2, "/a/c"), (3, "/a/d"), (4, "/x"), (5, "/x/c")], "client int, path string")
    assert {r.client: r.route_id for r in routes.match(asked, made).collect()} == {1: 2, 2: 4, 3: 4, 4: None, 5: 3}
    raw = spark.createDataFrame([("/u//<id>/**/x?q=1",), ("",), (None,)], "p string")
    assert [r[0] for r in raw.select(routes.normalise(F.col("p"))).collect()] == ["/u/:param/x", "/", None]


def test_ladder_stops_at_the_first_rung(spark):
    nodes = spark.createDataFrame([("1", "src/a.py", "run", "Job"), ("2", "src/b.py", "run", None), ("3", "run", "x", None)], "id string, path string, name string, owner string")
    asked = spark.createDataFrame([("1",), ("a.py:run",), ("run",), ("Job::run",), ("b.py",), ("nothing",)], "ref string")
    got = {}
    for r in linking.resolve(asked, nodes).collect():
        got.setdefault((r.ref, r.rung), set()).add(r.id)
    assert got == {("1", 1): {"1"}, ("a.py:run", 2): {"1"}, ("run", 4): {"1", "2"}, ("Job::run", 5): {"1"}, ("b.py", 6): {"2"}}


def test_calls_link_to_own_file_first(spark):
    defs = spark.createDataFrame([("d1", "f", "a", "py"), ("d2", "f", "b", "py"), ("d3", "g", "c", "py"), ("d4", "g", "b", "rs")], "id string, name string, path string, family string")
    sites = spark.createDataFrame([(1, "x", "f", "a", "py"), (2, "x", "f", "z", "py"), (3, "x", "g", "z", "py"), (4, "x", "f", "y", "py")], "site int, caller string, name string, path string, family string")
    imports = spark.createDataFrame([("z", "b")], "path string, target string")
    got = {(r.site, r.id): (r.weight, r.tier) for r in linking.link_names(sites, defs, imports, []).collect()}
    assert got == {(1, "d1"): (1.0, 1), (2, "d2"): (1.0, 1), (3, "d3"): (1.0, 0), (4, "d1"): (0.5, 0), (4, "d2"): (0.5, 0)}


def test_chase_ends_and_skips_cycles(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")
    assert {(r.name, r.target, r.steps) for r in linking.chase(a).collect()} == {("a", "c", 2), ("b", "c", 1)}


def test_members_come_from_the_nearest_base(spark):
    m = spark.createDataFrame([("A", "f", "1"), ("B", "f", "2"), ("A", "g", "3")], "owner string, name string, id string")
    b = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "C")], "owner string, base string")
    got = {(r.owner, r.name): r.id for r in linking.inherited(m, b).collect()}
    assert got == {("A", "f"): "1", ("A", "g"): "3", ("B", "f"): "2", ("B", "g"): "3", ("C", "f"): "2", ("C", "g"): "3"}


def test_merge_takes_the_later_and_recall_needs_a_word_far_away(spark):
    row = "id int, created int, updated int, body string"
    got = memory.merge(spark.createDataFrame([(1, 1, 5, "m"), (2, 1, 1, "m")], row), spark.createDataFrame([(1, 1, 5, "t"), (2, 1, 2, "t"), (3, 1, 1, "t")], row))
    assert {(r.id, r.body) for r in got.collect()} == {(1, "m"), (2, "t"), (3, "t")}
    notes = spark.createDataFrame([(1, "a", "x"), (2, "b", "has Word"), (3, "b", None)], "id int, target string, body string")
    near = spark.createDataFrame([("a", 0)], "target string, rank int")
    assert {(r.id, r["rank"], r.hits) for r in memory.recall(notes, near, ["word"]).collect()} == {(1, 0, 0), (2, 4, 1)}


def test_smallest_k_of_a_hot_key_is_exact(spark):
    rows = spark.range(1000).selectExpr("0 as k", "id")
    assert sorted(r.id for r in ranking.smallest_k(rows, ["k"], ["id"], 7).collect()) == list(range(7))


def test_score_of_an_unknown_cost_is_the_middle(spark):
    seats = spark.createDataFrame([(True, None, 0, 1, 0, 0.0, 0), (False, True, 1, 2, 0, 0.0, 1_800_000)], "passed boolean, tests boolean, refusals int, attempts int, tokens long, cost double, duration_ms long")
    assert [r.score for r in ledger.seat_scores(seats).collect()] == [95.0, 40.0]


def test_triples(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("x", "q", "é /")], "s string, p string, o string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert {r.end for r in triples.path_plus(t, "p", starts).collect()} == {"a", "b", "c"}
    assert not triples.ask(triples.match(t, ("?x", "q", "?y"), ("?y", "p", "?z"))).first().answer
    assert triples.n_triples(t.where("p = 'q'"), "u:").first().line == "<u:x> <u:q> <u:%C3%A9%20/> ."
    with pytest.raises(ValueError):
        triples.match(t, ("?x", "p", "?y"), ("?a", "q", "?b"))


def test_search_falls_back_only_if_nothing_begins(spark):
    rows = spark.createDataFrame([(1, "loadUserV2"), (2, "parse-http"), (3, None)], "id int, t string")
    assert [r[0] for r in rows.select(search.identifier_words(F.col("t"))).collect()] == ["load user v2", "parse http", None]
    words = search.identifier_words(F.col("t"))
    assert [(r.id, r.exact) for r in search.search_or_contain(rows, "id", words, "us lo").collect()] == [(1, True)]
    assert [(r.id, r.exact) for r in search.search_or_contain(rows, "id", words, "ttp").collect()] == [(2, False)]
    assert search.prefix_match(rows, "id", words, " ").count() == 0


def test_ready_needs_all_passed(spark):
    s = spark.createDataFrame([("a", "passed"), ("b", "queued"), ("c", "queued"), ("d", "failed")], "id string, state string")
    assert [r.id for r in ledger.ready(s, spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "d")], "id string, needs string")).collect()] == ["b"]
