"""Packs, gates, retention, schedules, scans and serialisations on literal rows and by brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scan, schedule
from weftgraph.operators import gates, packs, retention, triples

EDGES = [("a", "b"), ("b", "c"), ("b", "d"), ("x", "a"), ("a", "d")]


def edges(spark):
    return spark.createDataFrame([(*e, 1.0, 1, 2) for e in EDGES], "src string, dst string, weight double, line long, tier int")


def test_candidates_keep_the_best_relation(spark):
    tree = spark.createDataFrame([("box", "a")], "parent string, child string")
    got = packs.candidates(edges(spark), tree, spark.createDataFrame([("a",)], "seed string"))
    assert {(r.id, r.why) for r in got.collect()} == {("a", "seed"), ("b", "uses"), ("d", "uses"), ("x", "used by"), ("box", "container"), ("c", "2nd-order")}


@pytest.mark.parametrize("budget", [0, 24, 90, 400])
def test_pack_is_greedy_with_skips_and_signatures(spark, budget):
    rnd = random.Random(budget)
    rows = [(f"s{rnd.randint(0, 3)}", f"n{i:03}", *rnd.choice([("uses", 0.72), ("used by", 0.6), ("2nd-order", 0.34)]), rnd.randint(0, 5), rnd.randint(24, 120), rnd.randint(24, 60)) for i in range(300)]
    want = set()
    for seed in {r[0] for r in rows}:
        used = position = 0
        for _, node, why, _, _, cost, short in sorted((r for r in rows if r[0] == seed), key=lambda r: (-r[3], r[4], r[1])):
            if used + cost <= budget:
                used, sign = used + cost, False
            elif why != "2nd-order" and used + short <= budget:
                used, sign = used + short, True
            else:
                continue
            position += 1
            want.add((seed, node, why, position, sign, used))
    df = spark.createDataFrame(rows, "seed string, id string, why string, score double, span int, cost int, short int")
    got = packs.budget_pack(df.repartition(5), budget).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_pack_of_nothing(spark):
    df = spark.createDataFrame([], "seed string, id string, why string, score double, span int, cost int, short int")
    assert packs.budget_pack(df, 100).isEmpty()


def test_blast_leaves_the_changed_out(spark):
    changed = spark.createDataFrame([("d",), ("b",)], "id string")
    assert {(r.id, r.depth) for r in gates.blast(edges(spark), changed).collect()} == {("a", 1), ("x", 2)}


def test_reach_and_loops(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [r.path for r in gates.reach_beyond(paths("a/b", "c", "d/e", "c"), paths("c"), ["a"]).collect()] == ["d/e"]
    pairs = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    assert list(map(tuple, gates.new_loops(pairs(("a", "b"), ("a", "c")), pairs(("a", "b"))).collect())) == [("a", "c")]


@pytest.mark.parametrize(("risk", "level", "want"), [("low", 1, [True, True, True]), ("high", 2, [False, True, False])])
def test_gate_report(spark, risk, level, want):
    got = gates.report(spark.createDataFrame([(risk,)], "risk string"), spark.createDataFrame([("used",)], "state string"), spark.createDataFrame([(level,)], "level int"), "medium")
    assert [r.passed for r in sorted(got.collect(), key=lambda r: ["risk", "undeclared", "locked"].index(r.name))] == want


def test_retention(spark):
    log = spark.range(100).withColumn("text", F.lit("0123456789"))
    keep = lambda size, rows: {r.id for r in retention.retain_log(log, "id", F.length("text"), size, rows).collect()}
    assert keep(1001, 10) == set(range(100)) and keep(1000, 100) == set(range(100)) and keep(1000, 40) == set(range(80, 100))
    assert retention.retain_log(log.where("false"), "id", F.length("text"), 10, 10).isEmpty()
    trials = spark.createDataFrame([("k", i, None if i == 7 else i % 3 == 0) for i in range(30)], "run string, n int, kept boolean")
    got = {r.n for r in retention.prune_rejected(trials, "run", "n", F.col("kept"), 4).collect()}
    assert got == {i for i in range(30) if i % 3 == 0} | {1, 2, 4, 5}
    assert {r.n for r in retention.newest(trials, "run", "n", 3).collect()} == {27, 28, 29}


@pytest.mark.parametrize(
    ("spec", "hit"),
    [
        ("*/20 * * * *", lambda t: t.minute % 20 == 0),
        ("5 1-9/4 * * *", lambda t: t.minute == 5 and t.hour in (1, 5, 9)),
        ("0 0 1,15 * 7", lambda t: t.minute == t.hour == 0 and (t.day in (1, 15) or t.isoweekday() == 7)),
        ("0 12 * 2 1-5", lambda t: t.minute == 0 and t.hour == 12 and t.month == 2 and t.isoweekday() < 6),
    ],
)
def test_schedule(spark, spec, hit):
    start = datetime(2024, 1, 25)
    minutes = spark.range(60 * 24 * 12).select(F.expr("timestamp_ntz'2024-01-25 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0)").alias("ts"))
    want = {t for k in range(60 * 24 * 12) if hit(t := start + timedelta(minutes=k))}
    assert {r.ts for r in minutes.where(schedule.fires(F.col("ts"), spec)).collect()} == want and want


@pytest.mark.parametrize("spec", ["* * * *", "61 * * * *", "5-1 * * * *", "*/0 * * * *"])
def test_bad_schedule(spark, spec):
    with pytest.raises(ValueError):
        schedule.fires(F.lit(None).cast("timestamp"), spec)


def test_scans(spark):
    rows = [("took 3 s, then -4.50 s.", -4.5), ("none", None), ("", None), (None, None)]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select(scan.last_number(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in rows]
    usage = [('{"usage": {"total": 5}}', 5), ('{"k": 2.5}', 2.5), ('{"k": -1}', 0), ("{broken", 0), (None, 0)]
    got = spark.createDataFrame([r[:1] for r in usage], "t string").select(scan.json_number(F.col("t"), "$.usage.total", "$.k")).collect()
    assert [r[0] for r in got] == [r[1] for r in usage]
    html = spark.createDataFrame([('<a href="/x"><img src="y">',)], "h string")
    assert html.select(scan.links(F.col("h"))).first()[0] == ["/x", "y"]


def test_serialisations(spark):
    t = spark.createDataFrame([('a "b"', "calls", "c<d>")], "s string, p string, o string")
    assert triples.turtle(t, "urn:g/").first()[0] == "<a%20%22b%22> <calls> <c%3Cd%3E> ."
    assert triples.rdf_xml(t, "urn:g/").first()[0] == '<rdf:Description rdf:about="urn:g/a%20%22b%22"><g:calls rdf:resource="urn:g/c%3Cd%3E"/></rdf:Description>'
    assert triples.json_ld(t, "urn:g/").first()[0] == '{"@id":"urn:g/a%20%22b%22","urn:g/calls":{"@id":"urn:g/c%3Cd%3E"}}'
