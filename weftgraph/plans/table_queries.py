"""Search, interval, ledger, triple and window queries over the given tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import intervals, ledger, search, triples
from weftgraph.session import parts_of, read_table, shared_dir
from weftgraph.sources.projection import CALLS_SQL, calls, contains
from weftgraph.streaming import events as streams
from weftgraph.streaming import liveness

TERMS = ["tion", "and"]


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return search.bm25(docs, "doc_id", "text", TERMS)


def tfidf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tfidf_names(read_table(spark, sf_dir, "documents"), "source", "text")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("b"))
    orders = read_table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("a"), "b", "o_orderpriority")


def touched_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    urgent = spans.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("id").alias("range_id"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    return intervals.overlapping(spans, urgent, "o_custkey").where("id <> range_id").select("id", "range_id")


def innermost_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    points = spans.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("a").alias("point")).distinct()
    return intervals.innermost(points, spans.select("o_custkey", "id", "a", "b"), "o_custkey").fillna(-1, ["owner"])


def longest_prefix_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^.*?://([^?#]*)", 1).alias("path")).distinct()
    modules = paths.select(F.explode(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("module")).where("module like '%.com%' or module like '%/en'")
    return intervals.longest_prefix(paths, modules)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.sessions(read_table(spark, sf_dir, "events"), "user_id", "12 hours")


def current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current_runs(read_table(spark, sf_dir, "events"), "user_id", "signup", "2024-01-03 12:00:00", "12 hours")


def plan_diff_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.changes(read_table(spark, sf_dir, "events"), "user_id", "event_type")


def research_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_best(read_table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


def scorer_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_table(spark, sf_dir, "documents").where(~F.col("text").contains("!!") & ~F.col("text").contains("$$$")).select(F.col("doc_id").alias("id"))
    labels = read_table(spark, sf_dir, "labels")
    got = got.join(labels.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return ledger.precision_recall(got, labels.where("quality = 1").select(F.col("doc_id").alias("id")))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.state(calls(spark, sf_dir), contains(spark, sf_dir), once=True, parts=parts_of(read_table(spark, sf_dir, "lineitem")))


def triples_most_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = triples.match(_triples(spark, sf_dir), ("?x", "calls", "?y"), ("?y", "a", "supplier"))
    return hits.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(10)


def triples_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    return triples.match(t, ("?o", "a", "order")).join(triples.match(t, ("?o", "calls", "?p")), "o", "left_anti")


def triples_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    return triples.match(t, ("?s", "a", "supplier")).join(triples.match(t, ("?n", "contains", "?s")), "s", "left").select("s", "n")


def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it: a running value over one sort, no join of pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return read_table(spark, sf_dir, "events").withColumn("last_click", seen).where("event_type = 'purchase'").select("event_id", "last_click").fillna(-1, ["last_click"])


def rollup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).fillna(-1)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_to_table(streams.daily_counts(streams.event_stream(spark, f"{sf_dir}/events.parquet")))


def stream_live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as live runs: those silent for 12 hours end, and their states are told when they move."""
    log = liveness.live_log(streams.event_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "event_type", 43_200_000)
    return liveness.run_live(log, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}").select("key", "kind", "at", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("started", "n")], *[F.coalesce(c, F.lit("-")).alias(c) for c in ("before", "state")])


_SPANS = """spans AS (SELECT o_custkey, o_orderkey AS id, o_orderdate AS a, b, o_orderpriority FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
_WORDS = "w AS (SELECT doc_id AS id, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents)"
_CONTAINS = """contains AS (SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""
ORACLES = {
    "search_bm25": f"""WITH {_WORDS}, i AS (SELECT id, len(w) AS len, unnest(w) AS term FROM w), q AS (SELECT unnest({TERMS}) AS q),
p AS (SELECT id, len, q, count(*) AS tf FROM i JOIN q ON starts_with(term, q) GROUP BY 1, 2, 3), d AS (SELECT q, count(*) AS df FROM p GROUP BY 1), t AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w)
SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score FROM p JOIN d USING (q), t GROUP BY 1 HAVING count(*) = 2""",
    "tfidf_names": f"""WITH {_WORDS}, c AS (SELECT source AS "group", term, count(*) AS c FROM (SELECT source, unnest(w) AS term FROM w) GROUP BY 1, 2), t AS (SELECT "group", sum(c) AS total FROM c GROUP BY 1),
d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), s AS (SELECT "group", term, round(c::DOUBLE / total * ln(((SELECT count(DISTINCT source) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)), 9) AS score FROM c JOIN t USING ("group") JOIN d USING (term))
SELECT "group", term, score FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, term) AS r FROM s) WHERE r <= 2""",
    "touched_symbols": f"WITH {_SPANS} SELECT s.id, u.id AS range_id FROM spans s JOIN spans u ON s.o_custkey = u.o_custkey AND u.a <= s.b AND u.b >= s.a WHERE u.o_orderpriority = '1-URGENT' AND s.id <> u.id",
    "innermost_owner": f"""WITH {_SPANS}, p AS (SELECT DISTINCT o_custkey, a AS point FROM spans WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey, point, coalesce((SELECT arg_min(id, (epoch_us(b) - epoch_us(a)) * 1000000::HUGEINT + id) FROM spans s WHERE s.o_custkey = p.o_custkey AND s.a <= p.point AND p.point <= s.b), -1) AS owner FROM p""",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
    "current_runs": "SELECT user_id, max(ts) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-03 12:00:00' GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') = 0 AND max(ts) > TIMESTAMP '2024-01-03 00:00:00'",
    "plan_diff_cdc": "SELECT user_id, ts, event_id, before, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type",
    "research_running_best": "SELECT *, coalesce(value > best_before, true) AS kept FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events)",
    "scorer_precision_recall": """WITH g AS (SELECT doc_id FROM documents WHERE NOT contains(text, '!!') AND NOT contains(text, '$$$') AND doc_id IN (SELECT doc_id FROM labels)), w AS (SELECT doc_id FROM labels WHERE quality = 1),
n AS (SELECT count(*) FILTER (g.doc_id IS NOT NULL AND w.doc_id IS NOT NULL) AS tp, count(*) FILTER (w.doc_id IS NULL) AS fp, count(*) FILTER (g.doc_id IS NULL) AS fn FROM g FULL JOIN w ON g.doc_id = w.doc_id)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM n""",
    "triples_most_called": f"WITH {CALLS_SQL} SELECT dst AS y, count(*) AS n FROM calls WHERE dst LIKE 'supplier:%' GROUP BY 1 ORDER BY n DESC, y LIMIT 10",
    "triples_not_exists": "SELECT 'order:' || o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "triples_optional": "SELECT 'supplier:' || s_suppkey AS s, 'nation:' || s_nationkey AS n FROM supplier",
    "asof_last_event": "SELECT event_id, coalesce(last_click, -1) AS last_click FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events) WHERE event_type = 'purchase'",
    "rollup_sizes": "SELECT coalesce(n_regionkey, -1) AS n_regionkey, coalesce(c_nationkey, -1) AS c_nationkey, n FROM (SELECT n_regionkey, c_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey))",
    "stream_live_log": """WITH w AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS upto FROM events), e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id, event_type AS state FROM events, w WHERE epoch_us(ts) <= upto),
o AS (SELECT *, lag(state) OVER k AS before, coalesce(t - lag(t) OVER k > 43200000000, true)::INT AS fresh FROM e WINDOW k AS (PARTITION BY key ORDER BY t, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t, event_id) AS no FROM o)
SELECT key, 'end' AS kind, max(t) AS "at", min(t) AS started, count(*) AS n, '-' AS before, '-' AS state FROM s GROUP BY key, no HAVING max(t) + 43200000000 < (SELECT upto FROM w)
UNION ALL SELECT key, 'change', t, -1, -1, coalesce(before, '-'), state FROM s WHERE before IS DISTINCT FROM state""",
    "stream_daily_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "longest_prefix_module": """WITH p AS (SELECT DISTINCT regexp_extract(url, '^.*?://([^?#]*)', 1) AS path FROM pages), m AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS module FROM p),
k AS (SELECT module FROM m WHERE module LIKE '%.com%' OR module LIKE '%/en') SELECT path, (SELECT arg_max(module, length(module)) FROM k WHERE path = module OR starts_with(path, module || '/')) AS module FROM p""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
