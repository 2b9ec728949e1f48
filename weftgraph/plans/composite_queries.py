"""Packs, gates, retention, schedules, scans and serialisations over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scan, schedule
from weftgraph.operators import gates, levels, packs, retention, triples
from weftgraph.plans import policy_queries, record_queries
from weftgraph.session import cut, parts_of, read_table
from weftgraph.sources.projection import CALLS_SQL, FLOWS_SQL, calls, contains, key, named, nation_flows, number

BUDGET, CRON = 400, "*/15 8-17 1-15 * 1-5"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes are numbers; calls lead from orders to parts and from parts to suppliers, so none enters an order."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    calls_of = lambda a, b: lines.select(number("l_" + a[0], a[1]).alias("src"), number("l_" + b[0], b[1]).alias("dst"))
    order, part, supplier = ("orderkey", "order"), ("partkey", "part"), ("suppkey", "supplier")
    leaving, onward = calls_of(order, part), calls_of(part, supplier)
    entering = leaving.union(onward).where(F.pmod("dst", F.lit(4)) == 0)
    tree = orders.select(number("o_custkey", "customer").alias("parent"), number("o_orderkey", "order").alias("child"))
    return packs.around(leaving, onward, entering, tree, orders.select(number("o_orderkey", "order").alias("seed")), text=named, parts=parts_of(lines))


def context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds each order: its parts, their suppliers, its customer."""
    return _candidates(spark, sf_dir).select(named("seed").alias("seed"), named("id").alias("id"), "why", "score")


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for every order; an item is as long as its id says, some 60 to 400 characters."""
    chars = F.length("id") * F.when(F.col("why") == "uses", 40).otherwise(10)
    sized = _candidates(spark, sf_dir).withColumn("id", named("id")).withColumn("span", chars)
    short = packs.tokens(F.least("span", F.lit(60))) + packs.ITEM_TOKENS
    rows = sized.withColumns({"cost": packs.tokens(F.col("span")) + packs.ITEM_TOKENS, "short": short})
    return packs.budget_pack(rows, BUDGET, dealt_by_seed=True).withColumn("seed", named("seed"))


def slice_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on suppliers in debt."""
    poor = read_table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(key("supplier", "s_suppkey").alias("id"))
    return gates.blast(cut(calls(spark, sf_dir)), poor)


def slice_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts returned in bulk that are neither large nor economy."""
    parts = read_table(spark, sf_dir, "part").withColumn("path", F.concat_ws("/", F.lit("part"), "p_type", F.col("p_partkey").cast("string")))
    bulk = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return gates.reach_beyond(parts.join(bulk, "p_partkey"), parts.where("p_size > 40"), ["part/ECONOMY"])


def gate_new_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations that trade both ways, but not if only parts of the largest size are seen."""
    flows = cut(nation_flows(spark, sf_dir))
    largest = read_table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("l_partkey"))
    loops = lambda rows: levels.two_way_loops(levels.matrix(rows))
    return gates.new_loops(loops(flows), loops(flows.join(largest, "l_partkey", "left_semi")))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.report(record_queries.compare_risk(spark, sf_dir), policy_queries.deps_report(spark, sf_dir), policy_queries.guard_verdict(spark, sf_dir), "medium")


def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retain_log(read_table(spark, sf_dir, "events"), "event_id", F.octet_length("props"), 50_000, 4000).select("event_id", "user_id")


def ledger_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest(read_table(spark, sf_dir, "events"), "user_id", "event_id", 50).select("user_id", "event_id")


def gc_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.prune_rejected(read_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 50).select("user_id", "event_id")


def schedule_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read_table(spark, sf_dir, "events").where(schedule.fires(F.col("ts"), CRON))
    return hits.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = scan.json_number(F.col("props"), "$.usage.total_tokens", "$.k")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(used.cast("long")).alias("tokens"), F.count(F.lit(1)).alias("n"))


def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", scan.last_number(F.col("text")).alias("last_number"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.explode(scan.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, and whether a labelled document of good quality shows that it is supported."""
    docs = read_table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    good = docs.join(read_table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("lang").distinct()
    counted = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(good.withColumn("supported", F.lit(True)), "lang", "left").select("lang", "n", F.coalesce("supported", F.lit(False)).alias("supported"))


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.state(calls(spark, sf_dir), contains(spark, sf_dir), once=True, parts=parts_of(read_table(spark, sf_dir, "lineitem")))


def triples_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.turtle(_stated(spark, sf_dir), "urn:g/")


def triples_rdf_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.rdf_xml(_stated(spark, sf_dir), "urn:g/")


def triples_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.json_ld(_stated(spark, sf_dir), "urn:g/")


_CAND = f"""{CALLS_SQL}, u AS (SELECT src AS seed, dst AS used FROM calls WHERE src LIKE 'order:%'),
s2 AS (SELECT src, dst FROM calls QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 6),
f AS (SELECT DISTINCT 'order:' || o_orderkey AS seed, 'order:' || o_orderkey AS id, 'seed' AS why, 1.0::DOUBLE AS score FROM orders UNION ALL SELECT seed, used, 'uses', 0.72 FROM u JOIN (SELECT DISTINCT o_orderkey FROM orders) ON seed = 'order:' || o_orderkey
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'container', 0.55 FROM orders UNION ALL SELECT seed, dst, '2nd-order', 0.34 FROM u JOIN s2 ON used = src JOIN (SELECT DISTINCT o_orderkey FROM orders) ON seed = 'order:' || o_orderkey),
c AS (SELECT seed, id, arg_max(why, score) AS why, max(score) AS score FROM f GROUP BY 1, 2)"""
_TRIPLES = record_queries.STATED_SQL
_PAIRS = "SELECT DISTINCT x.src AS a, x.dst AS b FROM {0} x JOIN {0} y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst"
ORACLES = {
    "context_candidates": f"WITH {_CAND} SELECT seed, id, why, score FROM c",
    "context_pack": f"""WITH RECURSIVE {_CAND}, z AS (SELECT *, (length(id) * CASE why WHEN 'uses' THEN 40 ELSE 10 END)::BIGINT AS span FROM c),
o AS MATERIALIZED (SELECT seed, id, why, (ceil(span / 4) + 24)::BIGINT AS cost, (ceil(least(span, 60) / 4) + 24)::BIGINT AS short, row_number() OVER (PARTITION BY seed ORDER BY score DESC, span, id) AS rn FROM z),
r AS (SELECT DISTINCT seed, '' AS id, '' AS why, 0::BIGINT AS rn, 0::BIGINT AS position, 0 AS took, 0::BIGINT AS used FROM o
UNION ALL SELECT seed, id, why, rn, position + (took > 0)::BIGINT, took, used + CASE took WHEN 2 THEN cost WHEN 1 THEN short ELSE 0 END
FROM (SELECT o.*, r.position, r.used, CASE WHEN used + cost <= {BUDGET} THEN 2 WHEN used + short <= {BUDGET} AND o.why <> '2nd-order' THEN 1 ELSE 0 END AS took FROM r JOIN o ON r.seed = o.seed AND o.rn = r.rn + 1))
SELECT seed, id, why, position, took = 1 AS signature_only, used FROM r WHERE rn > 0 AND took > 0""",
    "slice_blast": """WITH p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0)
SELECT 'part:' || l_partkey AS id, 1 AS depth FROM p UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 2 FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM p)""",
    "slice_reach": """SELECT DISTINCT 'part/' || p_type || '/' || p_partkey AS path FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 AND p_size <= 40 AND p_type <> 'ECONOMY'""",
    "gate_new_loops": f"""WITH {FLOWS_SQL}, w AS (SELECT DISTINCT src, dst FROM flows), q AS (SELECT DISTINCT src, dst FROM flows JOIN part ON l_partkey = p_partkey WHERE p_size = 50)
{_PAIRS.format("w")} EXCEPT {_PAIRS.format("q")}""",
    "gate_report": f"""SELECT 'risk' AS name, risk AS value, risk <> 'high' AS passed FROM ({record_queries.ORACLES["compare_risk"]})
UNION ALL SELECT 'undeclared', (count(*) FILTER (state = 'undeclared'))::VARCHAR, count(*) FILTER (state = 'undeclared') = 0 FROM ({policy_queries.ORACLES["deps_report"]})
UNION ALL SELECT 'locked', (count(*) FILTER (level >= 2))::VARCHAR, count(*) FILTER (level >= 2) = 0 FROM ({policy_queries.ORACLES["guard_verdict"]})""",
    "event_retention": """WITH n AS (SELECT sum(strlen(props)) AS bytes, count(*) AS n FROM events)
SELECT event_id, user_id FROM events WHERE (SELECT bytes < 50000 OR n <= 4000 FROM n) OR event_id IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2000)""",
    "ledger_newest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50",
    "gc_rejected": """WITH e AS (SELECT user_id, event_id, coalesce(value > 50, false) AS kept FROM events) SELECT user_id, event_id FROM e QUALIFY kept OR row_number() OVER (PARTITION BY user_id, kept ORDER BY event_id) <= 10""",
    "schedule_fires": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND (day(ts) <= 15 OR dayofweek(ts) BETWEEN 1 AND 5) GROUP BY 1""",
    "usage_totals": "SELECT event_type, sum(greatest(coalesce((props->>'$.k')::DOUBLE, 0), 0)::BIGINT)::BIGINT AS tokens, count(*) AS n FROM events GROUP BY 1",
    "last_numbers": rf"SELECT doc_id, regexp_extract_all(text, '{scan.NUMBER}')[-1]::DOUBLE AS last_number FROM documents",
    "page_links": """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src|action)="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""",
    "missing_languages": """SELECT lang, count(*) AS n, lang IN (SELECT lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang IS NOT NULL) AS supported FROM documents WHERE lang IS NOT NULL GROUP BY 1""",
    "triples_turtle": f"WITH {_TRIPLES} SELECT '<' || s || '> <' || p || '> <' || o || '> .' AS line FROM t",
    "triples_rdf_xml": f"""WITH {_TRIPLES} SELECT '<rdf:Description rdf:about="urn:g/' || s || '"><g:' || p || ' rdf:resource="urn:g/' || o || '"/></rdf:Description>' AS line FROM t""",
    "triples_json_ld": f"""WITH {_TRIPLES} SELECT '{{"@id":"urn:g/' || s || '","urn:g/' || p || '":{{"@id":"urn:g/' || o || '"}}}}' AS line FROM t""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
