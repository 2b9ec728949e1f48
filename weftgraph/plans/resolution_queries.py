"""Imports, proven calls, plans, areas, typed links and declared tables, on files and symbols named by the given tables.

The SQL states what the rows say, without keys, tails or steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import planning, resolution
from weftgraph.session import read_table, wide
from weftgraph.sources import table_scan
from weftgraph.sources.projection import CALLS_SQL, calls, key

#: number of the brand that a nation's package gives names of
_BRAND_OF = "(n_nationkey % 5 + 1) * 10 + n_nationkey div 5 + 1"


def _name(form: str, *columns: str | Column) -> Column:
    return F.format_string(form, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def _brand_no() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)$", 1)


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the nation of their supplier."""
    return read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts import the one with half their number; a script imports suppliers and nations by full, short and relative names."""
    s, n, p = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "part"))
    of_part = _name("web/b%s/p%s.ts", _brand_no(), "p_partkey")
    files = s.select(_name("py/n%s/s%s.py", "s_nationkey", "s_suppkey").alias("path")).union(n.select(_name("py/n%s/__init__.py", "n_nationkey"))).union(p.select(of_part))
    half = p.select(F.col("p_partkey").alias("half"), _name("'../b%s/p%s'", _brand_no(), "p_partkey").alias("raw"))
    own = p.join(wide(half), F.expr("p_partkey div 2") == F.col("half")).select(_name("t:%s", "p_partkey").alias("site"), of_part.alias("path"), F.lit("typescript").alias("lang"), "raw")
    pairs = _supplied(spark, sf_dir).select("l_partkey", "l_suppkey", "s_nationkey").distinct()
    k = F.col("l_partkey") % 4
    raw = F.when(k == 0, _name("n%s.s%s", "s_nationkey", "l_suppkey")).when(k == 1, _name("s%s", "l_suppkey")).when(k == 2, _name(".n%s", "s_nationkey")).otherwise(_name("n%s", "s_nationkey"))
    return resolution.import_files(own.union(pairs.select(_name("p:%s:%s", "l_partkey", "l_suppkey"), F.lit("py/main.py"), F.lit("python"), raw)), files)


def structured_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers call names that their nation's package takes from a brand, and members of the nation.

    A brand defines its parts by size, a nation the segments of its rich customers; a nation inherits from the one
    with half its number.
    """
    part, nation, customer, orders = (read_table(spark, sf_dir, t) for t in ("part", "nation", "customer", "orders"))
    of_size = _name("f%s", "p_size")
    rich = customer.where("c_acctbal > 8000").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("k"))
    defs = part.select(key("part", "p_partkey").alias("id"), _name("b%s", _brand_no()).alias("path"), of_size.alias("name"), F.lit(None).cast("string").alias("owner"))
    defs = defs.union(nation.select(_name("n:%s", "n_nationkey"), _name("n%s", "n_nationkey"), F.lit("Nation"), F.lit(None)))
    defs = defs.union(rich.select(key("customer", "k"), _name("n%s", "c_nationkey"), "c_mktsegment", _name("n:%s", "c_nationkey")))
    again = part.select(_brand_no().alias("b"), of_size.alias("name")).distinct().join(nation, F.col("b") == F.expr(_BRAND_OF).cast("string"))
    again = again.select(_name("n%s", "n_nationkey").alias("path"), "name", _name("b%s", "b").alias("target"), F.col("name").alias("exported"))
    lines = _supplied(spark, sf_dir).join(part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    names = lines.select("l_suppkey", "s_nationkey", of_size.alias("f")).distinct()
    file, package = _name("s%s", "l_suppkey"), _name("n%s", "s_nationkey")
    bindings = names.select(file.alias("path"), F.col("f").alias("local"), package.alias("target"), F.col("f").alias("exported"))
    bindings = bindings.union(names.select("l_suppkey", "s_nationkey").distinct().select(file, F.lit("mod"), package, F.lit(None)))
    bases = nation.where("n_nationkey > 0").select(_name("n:%s", "n_nationkey").alias("owner"), _name("n:%s", F.expr("n_nationkey div 2")).alias("base"))
    segment = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    rows = lines.join(segment, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber") % 3
    sites = rows.select(
        _name("%s:%s:%s:%s", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("site"), file.alias("path"), F.lit(0).alias("scope"), _name("n:%s", "s_nationkey").alias("owner"),
        F.when(n == 1, "mod").when(n == 2, "self").alias("receiver"), F.when(n == 2, F.col("c_mktsegment")).otherwise(of_size).alias("name"),
    )
    types = spark.createDataFrame([], "path string, scope int, local string, type string")
    return resolution.structured_calls(sites, defs, bindings, bases, types, again)


def interface_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers name a part's type and size, through its brand if their nation's number is even."""
    part = read_table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_type", "p_size")
    asked = read_table(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("p_partkey"))
    through = F.when(F.col("c_nationkey") % 2 == 0, F.col("p_brand")).otherwise("none")
    return resolution.interface_targets(asked.select(key("customer", "c_custkey").alias("site"), through.alias("interface"), name.alias("name")), part.select(key("part", "p_partkey").alias("id"), F.col("p_brand").alias("owner"), name.alias("name")))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with rich customers, which wait for nations that they buy the largest lots from one way only."""
    customer = read_table(spark, sf_dir, "customer")
    rows = customer.select(key("customer", "c_custkey").alias("path"), key("nation", "c_nationkey").alias("module"), "c_acctbal", "c_custkey")
    lots = _supplied(spark, sf_dir).where("l_quantity = 50 and l_discount = 0").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lots.join(rows, F.col("o_custkey") == F.col("c_custkey")).select(F.col("module").alias("src"), key("nation", "s_nationkey").alias("dst"))
    return planning.slices(rows.where("c_acctbal > 9000").select("path"), rows.select("path", "module"), edges)


def plan_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).withColumn("deps", F.array_join("deps", " "))


def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.in_order(_plan(spark, sf_dir))


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the pages by last label of the host, first folder, host and the rest."""
    host, rest = F.regexp_extract("url", r"^.*?://([^/?#]*)", 1), F.regexp_extract("url", r"^.*?://[^/?#]*/?([^?#]*)", 1)
    path = F.concat_ws("/", F.substring_index(host, ".", -1), F.substring_index(rest, "/", 1), host, rest)
    return planning.territories(read_table(spark, sf_dir, "pages").select(path.alias("path")))


def typed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts count as classes, suppliers as interfaces; nations import their region."""
    edges = calls(spark, sf_dir).select("src", "dst", F.lit("CALLS").alias("kind"))
    nation, part = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "part")
    edges = edges.union(nation.select(key("nation", "n_nationkey"), key("region", "n_regionkey"), F.lit("IMPORTS")))
    nodes = part.select(key("part", "p_partkey").alias("id"), F.when(F.col("p_size") > 25, "class").otherwise("function").alias("kind"), F.col("p_brand").alias("file"))
    nodes = nodes.union(read_table(spark, sf_dir, "orders").select(key("order", "o_orderkey"), F.lit("function"), "o_orderpriority"))
    nodes = nodes.union(read_table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(key("supplier", "s_suppkey"), F.lit("interface"), key("nation", "s_nationkey")))
    nodes = nodes.union(nation.select(key("nation", "n_nationkey"), F.lit("file"), "n_name")).union(read_table(spark, sf_dir, "region").select(key("region", "r_regionkey"), F.lit("file"), "r_name"))
    return planning.typed_links(edges, nodes)


_SCRIPT = """CREATE TABLE IF NOT EXISTS shop."S%1$s" (a int); -- create table never (a int)
/* create table gone () */ ALTER TABLE ONLY public.n%2$s ADD x int;
INSERT INTO s%1$s SELECT * FROM shop.N%2$s JOIN other.missing ON a = 'from n1'"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(_name("db/s%s.sql", "s_suppkey").alias("path"), _name(_SCRIPT, "s_suppkey", "s_nationkey").alias("text"))


def declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_scan.declared_tables(_scripts(spark, sf_dir))


def used_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_scan.used_tables(_scripts(spark, sf_dir))


_NO = "regexp_extract(p_brand, '([0-9]+)$', 1)"
_PLAN_SQL = """rich AS (SELECT 'nation:' || c_nationkey AS id, count(*) AS files FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
e AS (SELECT DISTINCT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_quantity = 50 AND l_discount = 0 AND c_nationkey <> s_nationkey),
d AS (SELECT src AS id, list(dst ORDER BY dst) AS deps FROM e WHERE src IN (SELECT id FROM rich) AND dst IN (SELECT id FROM rich) AND NOT EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src) GROUP BY 1),
s AS (SELECT id, files, coalesce(deps, []) AS deps FROM rich LEFT JOIN d USING (id))"""
ORACLES = {
    "import_targets": f"""SELECT 't:' || a.p_partkey AS site, 'web/b' || {_NO.replace("p_brand", "b.p_brand")} || '/p' || b.p_partkey || '.ts' AS target, 2 AS tier FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2
UNION ALL SELECT 'p:' || l_partkey || ':' || l_suppkey, 'py/n' || s_nationkey || CASE WHEN l_partkey % 4 < 2 THEN '/s' || l_suppkey ELSE '/__init__' END || '.py', CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey""",
    "structured_targets": f"""WITH RECURSIVE m AS (SELECT c_nationkey AS owner, c_mktsegment AS name, min(c_custkey) AS id FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2),
u AS (SELECT n_nationkey AS owner, n_nationkey AS up, 0 AS steps FROM nation UNION ALL SELECT owner, up // 2, steps + 1 FROM u WHERE up > 0 AND steps < 5),
inh AS (SELECT u.owner, m.name, arg_min(m.id, steps) AS id FROM u JOIN m ON u.up = m.owner GROUP BY 1, 2)
SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS site, 'part:' || d.id AS id, CASE l_linenumber % 3 WHEN 0 THEN 2 ELSE 3 END AS rule FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN (SELECT {_NO}::INT AS b, p_size, min(p_partkey) AS id FROM part GROUP BY 1, 2 HAVING count(*) = 1) d ON d.b = (s_nationkey % 5 + 1) * 10 + s_nationkey // 5 + 1 AND d.p_size = p.p_size WHERE l_linenumber % 3 <> 2
UNION ALL SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'customer:' || inh.id, 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN inh ON inh.owner = s_nationkey AND inh.name = c_mktsegment WHERE l_linenumber % 3 = 2""",
    "interface_calls": """WITH m AS (SELECT 'part:' || p_partkey AS id, p_brand AS owner, p_type || ' ' || p_size AS name FROM part),
c AS (SELECT 'customer:' || c_custkey AS site, CASE WHEN c_nationkey % 2 = 0 THEN p_brand ELSE 'none' END AS interface, p_type || ' ' || p_size AS name FROM customer JOIN part ON c_custkey = p_partkey)
SELECT site, CASE WHEN others = 1 THEN other_id ELSE own_id END AS id FROM (SELECT site, count(*) FILTER (owner <> interface) AS others, count(*) FILTER (owner = interface) AS own,
  min(id) FILTER (owner <> interface) AS other_id, min(id) FILTER (owner = interface) AS own_id FROM c JOIN m USING (name) GROUP BY site) WHERE others = 1 OR (others = 0 AND own = 1)""",
    "plan_slices": f"WITH {_PLAN_SQL} SELECT id, files, array_to_string(deps, ' ') AS deps FROM s",
    "plan_order": f"""WITH RECURSIVE {_PLAN_SQL}, whole AS (SELECT list({{'id': id, 'deps': deps}}) AS rows FROM s),
t AS (SELECT -1 AS step, NULL::VARCHAR AS id, []::VARCHAR[] AS done UNION ALL
  SELECT step + 1, pick, list_append(done, pick) FROM (SELECT step, done, coalesce(list_min([x.id FOR x IN rows IF NOT list_contains(done, x.id) AND list_has_all(done, x.deps)]), list_min([x.id FOR x IN rows IF NOT list_contains(done, x.id)])) AS pick FROM t, whole) WHERE pick IS NOT NULL)
SELECT step, id FROM t WHERE step >= 0""",
    "typed_links": f"""WITH {CALLS_SQL}, n AS (SELECT 'part:' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'class' ELSE 'function' END AS kind, p_brand AS file FROM part UNION ALL SELECT 'order:' || o_orderkey, 'function', o_orderpriority FROM orders
UNION ALL SELECT 'supplier:' || s_suppkey, 'interface', 'nation:' || s_nationkey FROM supplier WHERE s_acctbal > 0)
SELECT src, dst, a.file AS src_file, b.file AS dst_file, CASE WHEN b.kind IN ('class', 'interface') THEN 'types' ELSE 'calls' END AS base FROM calls JOIN n a ON a.id = src JOIN n b ON b.id = dst
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey, n_name, r_name, 'imports' FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "declared_tables": "SELECT 'db/s' || s_suppkey || '.sql' AS path, unnest(['s' || s_suppkey, 'n' || s_nationkey]) AS \"table\", 1::BIGINT AS times FROM supplier",
    "used_tables": """SELECT 'db/s' || s_suppkey || '.sql' AS path, 's' || s_suppkey AS "table", 'db/s' || s_suppkey || '.sql' AS declared_in FROM supplier
UNION ALL SELECT 'db/s' || s_suppkey || '.sql', 'n' || s_nationkey, min('db/s' || s_suppkey || '.sql') OVER (PARTITION BY s_nationkey) FROM supplier""",
}
#: ``territories`` goes by repeated splits, which are tested against plain code
QUERIES = {name: globals()[name] for name in (*ORACLES, "territories")}
