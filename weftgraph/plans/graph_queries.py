"""Graph queries over the projected tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import levels, traversal
from weftgraph.session import cut, parts_of, read_table
from weftgraph.sources.projection import CALLS_SQL, FLOWS_SQL, calls, contains, key, named, nation_flows, number, numbered_calls, tiered_calls

ROOT, PART = "supplier:7", "part:10"
BASE_DATE, HEAD_DATE = "1997-01-01", "1999-01-01"


def impact_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = calls(spark, sf_dir)
    return traversal.impact(edges, traversal.one_seed(edges, ROOT), True, 3).select("id", "depth", "tier")


def impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = calls(spark, sf_dir)
    return traversal.impact(edges, traversal.one_seed(edges, "order:3"), False, 3).select("id", "depth", "tier")


def impact_min_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = calls(spark, sf_dir)
    return traversal.impact(edges, traversal.one_seed(edges, ROOT), True, 2, floor=2).select("id", "depth", "tier")


def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = calls(spark, sf_dir).where("dst like 'supplier:%'")  # one step up from suppliers no other is met
    seeds = read_table(spark, sf_dir, "supplier").select(key("supplier", "s_suppkey").alias("seed")).withColumn("id", F.col("seed"))
    parts = parts_of(read_table(spark, sf_dir, "lineitem"))
    hits = traversal.impact(edges, seeds, True, 1, parts=parts)
    brands = read_table(spark, sf_dir, "part").select(key("part", "p_partkey").alias("id"), F.col("p_brand").alias("group"))
    return traversal.impact_summary(hits, brands, parts)


def trace_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.shortest_path(cut(calls(spark, sf_dir)), "order:3", ROOT)


def flows_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.flow_reach(numbered_calls(spark, sf_dir)).select(named("entry").alias("entry"), "reach")


def neighbours_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.neighbours(calls(spark, sf_dir, src=PART), PART, True)


def neighbours_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.neighbours(calls(spark, sf_dir, dst=PART), PART, False)


def context_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.context(calls(spark, sf_dir, src=ROOT).union(calls(spark, sf_dir, dst=ROOT)), contains(spark, sf_dir), ROOT)


def file_level_depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 2 * parts_of(read_table(spark, sf_dir, "lineitem"))  # a line is two calls
    members = [("orders", number("o_orderkey", "order"), key("customer", "o_custkey")), ("part", number("p_partkey", "part"), key("brand", "p_brand")), ("supplier", number("s_suppkey", "supplier"), key("nation", "s_nationkey"))]
    rows = [read_table(spark, sf_dir, t).select(i.alias("id"), o.alias("owner")) for t, i, o in members]
    return levels.lift(tiered_calls(spark, sf_dir, parts), rows[0].union(rows[1]).union(rows[2]), parts)


def coupling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.matrix(nation_flows(spark, sf_dir))


def package_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read_table(spark, sf_dir, "nation").select(key("nation", "n_nationkey").alias("id"), key("region", "n_regionkey").alias("owner"))
    return levels.lift(nation_flows(spark, sf_dir).withColumn("tier", F.lit(2)), regions)


def coupling_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.two_way_loops(levels.matrix(nation_flows(spark, sf_dir)))


#: nation pairs with fewer lines than the mean pair don't count as coupled
def _strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cut(levels.matrix(nation_flows(spark, sf_dir)))
    return m.join(F.broadcast(m.agg(F.avg("n").alias("mean")))).where("n > 1.3 * mean").drop("mean")


def coupling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.coupling_index(_strong(spark, sf_dir))


def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.instability(_strong(spark, sf_dir))


def module_cycles_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.strong_components(_strong(spark, sf_dir))


def label_propagation_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.label_propagation(_strong(spark, sf_dir).withColumn("weight", F.col("n").cast("double")), 3)


def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.degrees(calls(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(20)


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    churn = read_table(spark, sf_dir, "lineitem").groupBy(key("part", "l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("churn"))
    return levels.hotspots(calls(spark, sf_dir), churn, 20)


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("sha"), key("supplier", "l_suppkey").alias("path"), F.col("o_orderdate").alias("ts"), key("customer", "o_custkey").alias("author"))


def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), key("supplier", "l_suppkey").alias("path"))
    return levels.co_change(_commits(spark, sf_dir), ROOT, touched=touched)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).where(F.col("path") == ROOT).groupBy("author").agg(F.count_distinct("sha").alias("commits"))


def god_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    fans = lines.groupBy(key("part", "l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("fan"), F.count(F.lit(1)).alias("size"))
    return levels.god_nodes(fans, 20)


def dead_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select(key("part", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    sure = calls(spark, sf_dir).where("tier = 2 and weight > 1")
    return levels.uncalled(parts, sure)


def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.majority(read_table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = calls(spark, sf_dir, dst=ROOT)
    return edges.select(F.col("src").alias("id")).union(edges.sparkSession.createDataFrame([(ROOT,)], "id string")).distinct()


def isolate_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.isolate(calls(spark, sf_dir), _slice(spark, sf_dir))[0]


def isolate_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.isolate(calls(spark, sf_dir), _slice(spark, sf_dir))[1]


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines shipped before two dates, as two states of the graph."""
    lines = read_table(spark, sf_dir, "lineitem")
    return tuple(calls(spark, sf_dir, lines.where(F.col("l_shipdate") < F.lit(d).cast("timestamp_ntz"))) for d in (BASE_DATE, HEAD_DATE))


def graph_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.operators.diff import diff_edges

    return diff_edges(*_snapshots(spark, sf_dir))


def graph_diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.operators.diff import diff_nodes

    return diff_nodes(*_snapshots(spark, sf_dir))


def recheck_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.operators.diff import recheck

    return recheck(*_snapshots(spark, sf_dir), parts_of(read_table(spark, sf_dir, "lineitem")))


_LEVELS = CALLS_SQL + """,
l1 AS (SELECT {there} AS id, 1 AS depth, max(tier) AS tier FROM calls WHERE {here} = '{root}' AND tier >= {floor} GROUP BY 1),
l2 AS (SELECT {there} AS id, 2 AS depth, max(least(calls.tier, l1.tier)) AS tier FROM calls JOIN l1 ON calls.{here} = l1.id
  WHERE calls.tier >= {floor} AND {there} NOT IN (SELECT id FROM l1) AND {there} <> '{root}' GROUP BY 1),
l3 AS (SELECT {there} AS id, 3 AS depth, max(least(calls.tier, l2.tier)) AS tier FROM calls JOIN l2 ON calls.{here} = l2.id
  WHERE calls.tier >= {floor} AND {there} NOT IN (SELECT id FROM l1 UNION ALL SELECT id FROM l2) AND {there} <> '{root}' GROUP BY 1)"""
_UP = _LEVELS.format(here="dst", there="src", root=ROOT, floor=0)
_DOWN = _LEVELS.format(here="src", there="dst", root="order:3", floor=0)
_UP2 = _LEVELS.format(here="dst", there="src", root=ROOT, floor=2)
_ALL3 = " SELECT id, depth, tier FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3"
_MATRIX = FLOWS_SQL + ", m AS (SELECT src, dst, count(*) AS n FROM flows WHERE src <> dst GROUP BY 1, 2)"
_STRONG = _MATRIX + ", s AS (SELECT * FROM m WHERE n > 1.3::DOUBLE * (SELECT avg(n) FROM m))"
_SLICE = CALLS_SQL + f", i AS (SELECT DISTINCT src AS id FROM calls WHERE dst = '{ROOT}' UNION SELECT '{ROOT}')"
_OWN = """own AS (SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS owner FROM orders UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand FROM part
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""
_COMMITS = "commits AS (SELECT o_orderkey AS sha, 'supplier:' || l_suppkey AS path, o_orderdate AS ts, 'customer:' || o_custkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _state(name: str, date: str) -> str:
    return CALLS_SQL.replace("calls AS", f"{name} AS").replace("FROM lineitem", f"FROM lineitem WHERE l_shipdate < TIMESTAMP '{date}'")


_TWO = _state("base", BASE_DATE) + ", " + _state("head", HEAD_DATE)
_LPA = "".join(
    f""", v{k} AS (SELECT a.src AS id, label, w FROM arcs a JOIN p{k - 1} ON a.dst = p{k - 1}.id UNION ALL SELECT id, label, 0.05 FROM p{k - 1}),
u{k} AS (SELECT id, label, round(sum(w), 6) AS w FROM v{k} GROUP BY 1, 2),
p{k} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM u{k}) WHERE r = 1)"""
    for k in (1, 2, 3)
)

ORACLES = {
    "impact_upstream": f"WITH {_UP}{_ALL3}",
    "impact_downstream": f"WITH {_DOWN}{_ALL3}",
    "impact_min_tier": f"WITH {_UP2} SELECT id, depth, tier FROM l1 UNION ALL SELECT * FROM l2",
    "impact_summary": f"""WITH {CALLS_SQL}, h AS (SELECT dst AS seed, src AS id, tier, p_brand FROM calls JOIN part ON src = 'part:' || p_partkey WHERE dst LIKE 'supplier:%'),
a AS (SELECT seed, count(DISTINCT id) AS hits, count(*) AS direct, count(*) FILTER (tier = 0) AS guessed, count(*) FILTER (tier = 1) AS inferred, count(*) FILTER (tier = 2) AS resolved, count(DISTINCT p_brand) AS groups FROM h GROUP BY 1)
SELECT *, CASE WHEN hits >= 40 OR groups >= 5 THEN 'high' WHEN direct >= 5 OR hits >= 12 THEN 'medium' WHEN hits = 0 THEN 'none' ELSE 'low' END AS risk FROM a""",
    "trace_shortest": f"""WITH {CALLS_SQL}, p AS (SELECT min(x.dst) AS via FROM calls x JOIN calls y ON x.dst = y.src WHERE x.src = 'order:3' AND y.dst = '{ROOT}')
SELECT 0::INT AS step, 'order:3' AS id FROM p WHERE via IS NOT NULL UNION ALL SELECT 1, via FROM p WHERE via IS NOT NULL UNION ALL SELECT 2, '{ROOT}' FROM p WHERE via IS NOT NULL""",
    "flows_reach": f"""WITH {CALLS_SQL}, e AS (SELECT src AS id FROM calls GROUP BY 1 HAVING count(*) >= 2), f AS (SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = e.id)),
r AS (SELECT f.id AS entry, dst AS id FROM f JOIN calls ON src = f.id UNION SELECT f.id, y.dst FROM f JOIN calls x ON x.src = f.id JOIN calls y ON y.src = x.dst)
SELECT entry, count(*) AS reach FROM r GROUP BY 1""",
    "neighbours_out": f"WITH {CALLS_SQL} SELECT dst AS id, weight, tier FROM calls WHERE src = '{PART}'",
    "neighbours_in": f"WITH {CALLS_SQL} SELECT src AS id, weight, tier FROM calls WHERE dst = '{PART}'",
    "context_symbol": f"""WITH {CALLS_SQL} SELECT 'callee' AS relation, dst AS id, tier FROM calls WHERE src = '{ROOT}' UNION ALL SELECT 'caller', src, tier FROM calls WHERE dst = '{ROOT}'
UNION ALL SELECT 'container', 'nation:' || s_nationkey, 2 FROM supplier WHERE s_suppkey = 7""",
    "file_level_depends": f"WITH {CALLS_SQL}, {_OWN} SELECT a.owner AS src, b.owner AS dst, count(*) AS n, max(tier) AS tier FROM calls JOIN own a ON src = a.id JOIN own b ON dst = b.id WHERE a.owner <> b.owner GROUP BY 1, 2",
    "coupling_matrix": f"WITH {_MATRIX} SELECT * FROM m",
    "package_graph": f"WITH {FLOWS_SQL}, r AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS owner FROM nation) SELECT a.owner AS src, b.owner AS dst, count(*) AS n, 2::INT AS tier FROM flows JOIN r a ON src = a.id JOIN r b ON dst = b.id WHERE a.owner <> b.owner GROUP BY 1, 2",
    "coupling_loops": f"WITH {_MATRIX} SELECT x.src AS a, x.dst AS b, x.n AS forth, y.n AS back, least(x.n, y.n) AS weaker FROM m x JOIN m y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
    "coupling_index": f"WITH {_STRONG}, d AS (SELECT dst, count(DISTINCT src) AS d FROM s GROUP BY 1) SELECT round(sum(d)::DOUBLE / (count(*) * max(d)), 6) AS coupling FROM d",
    "instability": f"""WITH {_STRONG}, o AS (SELECT src AS id, count(DISTINCT dst) AS f FROM s GROUP BY 1), i AS (SELECT dst AS id, count(DISTINCT src) AS f FROM s GROUP BY 1)
SELECT coalesce(o.id, i.id) AS id, coalesce(i.f, 0) AS fan_in, coalesce(o.f, 0) AS fan_out, round(coalesce(o.f, 0)::DOUBLE / (coalesce(o.f, 0) + coalesce(i.f, 0)), 6) AS instability FROM o FULL JOIN i ON o.id = i.id""",
    "module_cycles_scc": f"""WITH RECURSIVE {_STRONG}, r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src)
SELECT x.src AS id, min(least(x.src, x.dst)) AS component FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY 1""",
    "label_propagation_k": f"""WITH {_STRONG}, arcs AS (SELECT src, dst, sum(n)::DOUBLE AS w FROM (SELECT src, dst, n FROM s UNION ALL SELECT dst, src, n FROM s) GROUP BY 1, 2),
p0 AS (SELECT DISTINCT src AS id, src AS label FROM arcs){_LPA} SELECT id, label FROM p3""",
    "degree_topk": f"WITH {CALLS_SQL} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls WHERE src <> dst) GROUP BY 1 ORDER BY degree DESC, id LIMIT 20",
    "hotspots": f"""WITH {CALLS_SQL}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) GROUP BY 1), c AS (SELECT 'part:' || l_partkey AS id, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1)
SELECT id, churn, degree, round(churn * ln(degree + 2.0::DOUBLE), 6) AS score FROM c JOIN g USING (id) ORDER BY score DESC, id LIMIT 20""",
    "co_change": f"""WITH {_COMMITS}, w AS (SELECT DISTINCT sha, ts FROM commits WHERE path = '{ROOT}' ORDER BY ts DESC, sha DESC LIMIT 150), f AS (SELECT DISTINCT sha, path FROM commits WHERE sha IN (SELECT sha FROM w)),
k AS (SELECT sha FROM f GROUP BY 1 HAVING count(*) <= 40) SELECT path, count(*) AS n FROM f WHERE sha IN (SELECT sha FROM k) AND path <> '{ROOT}' GROUP BY 1 HAVING count(*) >= 2""",
    "owners": f"WITH {_COMMITS} SELECT author, count(DISTINCT sha) AS commits FROM commits WHERE path = '{ROOT}' GROUP BY 1",
    "god_modules": "WITH f AS (SELECT 'part:' || l_partkey AS id, count(DISTINCT l_orderkey) AS fan, count(*) AS size FROM lineitem GROUP BY 1) SELECT * FROM f WHERE fan > (SELECT quantile_cont(fan::DOUBLE, 0.95) FROM f) AND size > 20",
    "dead_candidates": f"WITH {CALLS_SQL} SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = 'part:' || p_partkey AND tier = 2 AND weight > 1)",
    "majority_label": "SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE r = 1",
    "isolate_internal": f"WITH {_SLICE} SELECT src, dst, weight, tier FROM calls WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)",
    "isolate_boundary": f"""WITH {_SLICE}, x AS (SELECT CASE WHEN src IN (SELECT id FROM i) THEN dst ELSE src END AS outside, CASE WHEN src IN (SELECT id FROM i) THEN 'out' ELSE 'in' END AS direction,
CASE WHEN src IN (SELECT id FROM i) THEN src ELSE dst END AS member FROM calls WHERE (src IN (SELECT id FROM i)) <> (dst IN (SELECT id FROM i)))
SELECT outside, direction, count(*) AS n, count(DISTINCT member) AS members FROM x GROUP BY 1, 2""",
    "graph_diff_edges": f"""WITH {_TWO} SELECT coalesce(b.src, h.src) AS src, coalesce(b.dst, h.dst) AS dst, CASE WHEN b.src IS NULL THEN 'added' WHEN h.src IS NULL THEN 'removed' WHEN b.weight <> h.weight OR b.tier <> h.tier THEN 'changed' ELSE 'same' END AS status
FROM base b FULL JOIN head h ON b.src = h.src AND b.dst = h.dst""",
    "graph_diff_nodes": f"""WITH {_TWO}, b AS (SELECT id, sum(weight) AS body FROM (SELECT src AS id, weight FROM base UNION ALL SELECT dst, weight FROM base) GROUP BY 1), h AS (SELECT id, sum(weight) AS body FROM (SELECT src AS id, weight FROM head UNION ALL SELECT dst, weight FROM head) GROUP BY 1)
SELECT coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.body <> h.body THEN 'modified' ELSE 'same' END AS status FROM b FULL JOIN h ON b.id = h.id""",
    "recheck_callers": f"""WITH {_TWO}, b AS (SELECT id, sum(weight) AS body FROM (SELECT src AS id, weight FROM base UNION ALL SELECT dst, weight FROM base) GROUP BY 1), h AS (SELECT id, sum(weight) AS body FROM (SELECT src AS id, weight FROM head UNION ALL SELECT dst, weight FROM head) GROUP BY 1),
n AS (SELECT h.id, CASE WHEN b.id IS NULL THEN 'added' WHEN b.body <> h.body THEN 'modified' ELSE 'same' END AS status FROM h LEFT JOIN b ON b.id = h.id)
SELECT src AS caller, dst AS callee FROM head JOIN n x ON src = x.id JOIN n y ON dst = y.id WHERE x.status = 'same' AND y.status = 'modified'""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
