"""Flows, definitions, declared models, groups of files and teams over the given tables, and their SQL.

Sources are written from rows; the SQL states what the rows say, without reading a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import flowmap, planning, resolution
from weftgraph.session import cut, read_table, spread
from weftgraph.sources import definitions, table_scan
from weftgraph.sources.projection import key


def _name(form: str, *columns: str | Column) -> Column:
    return F.format_string(form, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a function that calls its parts line by line: as they come, behind a condition, or in a loop."""
    flag, part = F.col("x.l_returnflag"), F.col("x.l_partkey").cast("string")
    rows = read_table(spark, sf_dir, "lineitem")
    lines = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("all"))  # an order has a few lines
    call = lambda x: F.concat(F.lit("part_"), x["l_partkey"].cast("string"))
    text = lambda x: F.when(x["l_returnflag"] == "N", F.array(F.concat(F.lit("    xpart_1() + "), call(x), F.lit("(x)")))).when(
        x["l_returnflag"] == "A", F.array(F.lit("    if ok:"), F.concat(F.lit("        "), call(x), F.lit(" ()")))
    ).otherwise(F.array(F.lit("    for i in x:"), F.concat(F.lit("\t\t"), call(x), F.lit("::<T>(x)"))))
    nodes = lines.select(key("order", "l_orderkey").alias("id"), F.lit(10).alias("first"), F.concat(F.array(F.lit("def f():")), F.flatten(F.transform("all", text))).alias("body"))
    calls = rows.select("l_orderkey", "l_partkey").distinct().select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"))
    return flowmap.placed(calls.withColumn("tier", F.lit(2)), nodes).select("src", "dst", "site", "branch")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "part")
    suppliers = s.select(key("supplier", "s_suppkey").alias("id"), _name("S%s", "s_suppkey").alias("name"), _name("src/n%s/s%s", "s_nationkey", "s_suppkey").alias("path"), key("nation", "s_nationkey").alias("domain"))
    return suppliers.union(p.select(key("part", "p_partkey"), "p_name", F.concat_ws("/", F.lit("src"), "p_type", "p_brand"), F.col("p_type")))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers call the parts that they deliver, and parts the suppliers of their large lots."""
    rows = read_table(spark, sf_dir, "lineitem")
    a = rows.groupBy("l_suppkey", "l_partkey").agg(F.when(F.min("l_returnflag") == "N", 0).otherwise(F.min("l_linenumber")).alias("site"), F.max("l_quantity").alias("q"))
    sold = a.select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"), "site")
    back = a.where("q >= 40").select(key("part", "l_partkey"), key("supplier", "l_suppkey"), "site")
    return sold.union(back).select("src", "dst", F.col("dst").alias("name"), F.col("site").cast("long").alias("site"), F.lit(None).cast("string").alias("branch"), F.lit(2).alias("tier"))


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that owe are handled by a route of their nation; the others are functions that parts may call."""
    s = read_table(spark, sf_dir, "supplier")
    routes = s.where("s_acctbal < 0").select(key("nation", "s_nationkey").alias("route"), key("supplier", "s_suppkey").alias("id"))
    nodes = s.select(key("supplier", "s_suppkey").alias("id"), F.lit("function").alias("kind"), F.when(F.col("s_nationkey") < 5, "main").otherwise("s").alias("name"), F.lit(False).alias("test"))
    return flowmap.entries(routes, nodes, cut(_trade(spark, sf_dir)))


def flow_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, and orders of three parts or more, which nothing calls; closed ones are tests."""
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    calls = lines.select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst")).distinct()
    nodes = orders.select(key("order", "o_orderkey").alias("id"), F.lit("method").alias("kind"), F.lit("o").alias("name"), (F.col("o_orderstatus") == "F").alias("test"))
    routes = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("route"), key("order", "o_orderkey").alias("id"))
    return flowmap.entries(routes, nodes, calls)


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    starts = cut(_starts(spark, sf_dir))
    return starts, cut(flowmap.unrolled(starts, cut(_trade(spark, sf_dir))))


def flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flowmap.unrolled(_starts(spark, sf_dir), cut(_trade(spark, sf_dir))).select("entry", "step", "id", "depth", "parent", "site")


def flow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, steps = _steps(spark, sf_dir)
    return flowmap.flows(starts, steps, _nodes(spark, sf_dir))


def flow_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, steps = _steps(spark, sf_dir)
    nodes = _nodes(spark, sf_dir)
    return flowmap.domains(cut(flowmap.flows(starts, steps, nodes)), steps, nodes)


_PY = '''from .n%2$s import f%2$s
class S%1$s(Base):
    """def no_%1$s(): pass"""
    def sell_%1$s(self):
        return self.pay(f%2$s("g(1)"))  # h(2)

    def pay(self, x):
        return x
def main():
    S%1$s().sell_%1$s()
'''
_RS = """use crate::r%2$s::go;
pub struct N%1$s { a: u8 }
impl N%1$s {
    pub fn run<'a>(&self) -> u8 {
        inner::leaf_%1$s(self.a)
    }
}"""
_VUE = """<template>é<a>f(1)</a></template>
<script>
import x from './r%1$s'
function v%1$s() {
  w%1$s(); // y()
}
</script>"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    py = s.select(_name("s%s.py", "s_suppkey").alias("path"), F.lit("python").alias("lang"), _name(_PY, "s_suppkey", "s_nationkey").alias("text"))
    rs = n.select(_name("n%s.rs", "n_nationkey"), F.lit("rust"), _name(_RS, "n_nationkey", "n_regionkey"))
    return py.union(rs).union(r.select(_name("r%s.vue", "r_regionkey"), F.lit("vue"), _name(_VUE, "r_regionkey")))


def source_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.definitions(_code(spark, sf_dir)).select("path", "kind", "name", "owner", "first", "last", F.octet_length("body").cast("long").alias("bytes"))


def source_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.call_names(_code(spark, sf_dir))


def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.imports(_code(spark, sf_dir))


def script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as components: only scripts stay, and every byte keeps its place."""
    html = F.coalesce(F.col("html"), F.lit(""))
    kept = read_table(spark, sf_dir, "pages").select("page_id", html.alias("html"), definitions.script_parts(html, F.lit("vue")).alias("kept"))
    return kept.select("page_id", F.octet_length("kept").cast("long").alias("bytes"), F.length(F.regexp_replace("kept", r"[ \n]", "")).cast("long").alias("letters"))


_DJANGO = """from django.db import models
class Nation%2$s(models.Model):
    class Meta:
        abstract = True
class Supplier%1$s(Nation%2$s):
    x = 1
class Other%1$s(Nation%2$s):
    class Meta:
        db_table = 'Other_%2$s'
class Plain%1$s: pass"""
_ALCHEMY = "class A%1$s(Base):\n    __tablename__ = 'Part_%2$s'\n"
_KIT = "const make = pgTableCreator((n) => `b%2$s_${n}`); // make('never')\nexport const t%1$s = make('T%1$s', {});\nmysqlTable(`brand_%2$s`);"
_PRISMA = 'model Nation%1$s {\n  id Int\n  @@map("n_%2$s")\n}\nmodel Pet%1$s {\n  id Int\n}'


def declared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, n = (read_table(spark, sf_dir, t) for t in ("supplier", "part", "nation"))
    s, p = spread(s.select("s_suppkey", "s_nationkey")), spread(p.select("p_partkey", "p_brand"))
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1)

    def written(df: DataFrame, path: str, lang: str, text: str, a: str, b: str | Column) -> DataFrame:
        return df.select(_name(path, a).alias("path"), F.lit(lang).alias("lang"), _name(text, a, b).alias("text"))

    sources = written(s, "app/Shop%s/models/m.py", "python", _DJANGO, "s_suppkey", "s_nationkey").union(written(p, "p%s.py", "python", _ALCHEMY, "p_partkey", brand))
    return table_scan.declared_models(sources.union(written(p, "p%s.ts", "typescript", _KIT, "p_partkey", brand)).union(written(n, "n%s.prisma", "prisma", _PRISMA, "n_nationkey", "n_regionkey")))


def alias_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts import the one with half their number through ``@b/``, a third of it through the base folder."""
    p = read_table(spark, sf_dir, "part")
    files = p.select(_name("web/b/p%s/index.ts", "p_partkey").alias("path"))
    half, third = _name("'@b/p%s'", F.expr("p_partkey div 2")), _name('"b/p%s/index.ts"', F.expr("p_partkey div 3"))
    rows = p.select(_name("%s", "p_partkey").alias("site"), F.lit("web/main.ts").alias("path"), F.lit("typescript").alias("lang"), F.when(F.col("p_partkey") % 2 == 0, half).otherwise(third).alias("raw"))
    return resolution.import_files(rows, files, aliases=(("@c", "none"), ("@b/*", "b/*")), base_url="web")


def folder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and first folder."""
    path = F.concat(F.lit("www/"), F.regexp_extract("url", r"\.([a-z]+)(?:[/?#]|$)", 1), F.lit("/"), F.regexp_extract("url", r"^.*?://[^/?#]*/?([^?#/]*)", 1), F.lit("/p"), F.col("page_id").cast("string"))
    return planning.groups(read_table(spark, sf_dir, "pages").select(path.alias("path")))


def team_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of nations over customers' paths; flows touch the rich customers."""
    nation, customer = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "customer")
    scopes = nation.select("n_name", F.when(F.col("n_regionkey") > 0, _name("n%s/", "n_nationkey")))
    return planning.seat_scopes(scopes.toDF("seat", "prefix"), customer.where("c_acctbal > 9900").select(_name("n%s/c%s", "c_nationkey", "c_custkey").alias("path")))


def team_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations hand off to the two after them in their region's order, wrapping around."""
    n = read_table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("from"), F.col("n_nationkey").alias("rank")), n.select("n_regionkey", F.col("n_name").alias("to"))
    return planning.hand_off_deps(a.join(b, "n_regionkey").where("from <> to").select("rank", "from", "to"))


_TRADE_SQL = """a AS (SELECT l_suppkey AS s, l_partkey AS p, CASE WHEN min(l_returnflag) = 'N' THEN 0 ELSE min(l_linenumber) END::BIGINT AS site, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
e AS (SELECT 'supplier:' || s AS src, 'part:' || p AS dst, site FROM a UNION ALL SELECT 'part:' || p, 'supplier:' || s, site FROM a WHERE q >= 40),
st AS (SELECT 'supplier:' || s_suppkey AS id, s_acctbal < 0 AS route, s_nationkey AS n,
  s_acctbal < 0 OR s_nationkey < 5 OR ('supplier:' || s_suppkey NOT IN (SELECT dst FROM e) AND (SELECT count(*) FROM e WHERE src = 'supplier:' || s_suppkey) >= 2) AS starts FROM supplier),
k AS (SELECT src, list({'id': dst, 'site': site} ORDER BY site = 0, site, dst) AS kids FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY site = 0, site, dst) AS r FROM e) WHERE r <= 40 GROUP BY 1),
t AS (SELECT id AS entry, 0 AS step, id, 0 AS depth, -1 AS parent, 0::BIGINT AS site, [id] AS seen, []::STRUCT(id VARCHAR, depth INT, parent INT, site BIGINT)[] AS stack FROM st WHERE starts
  UNION ALL SELECT entry, step + 1, rest[1].id, rest[1].depth, rest[1].parent, rest[1].site, list_append(seen, rest[1].id), rest[2:] FROM (SELECT entry, step, seen, list_filter(list_concat(
    CASE WHEN t.depth < 4 THEN list_transform(coalesce(kids, []), lambda x: {'id': x.id, 'depth': t.depth + 1, 'parent': t.step, 'site': x.site}) ELSE [] END, stack), lambda x: NOT list_contains(t.seen, x.id)) AS rest
    FROM t LEFT JOIN k ON k.src = t.id WHERE step < 39) WHERE len(rest) > 0)"""
_NODES_SQL = "nodes AS (SELECT 'supplier:' || s_suppkey AS id, 'src/n' || s_nationkey || '/s' || s_suppkey AS path FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'src/' || p_type || '/' || p_brand FROM part)"
_LIST_SQL = f"""WITH RECURSIVE {_TRADE_SQL}, {_NODES_SQL},
f AS (SELECT entry, count(*) AS steps, count(DISTINCT path) AS files FROM t LEFT JOIN nodes USING (id) GROUP BY 1),
fl AS (SELECT entry, CASE WHEN route THEN 'route' WHEN n < 5 THEN 'main' ELSE 'entry' END AS kind, CASE WHEN route THEN 'nation:' || n END AS route, 'nation:' || n AS domain, steps, files FROM f JOIN st ON st.id = entry WHERE steps > 1 OR route)"""
_NO = "regexp_extract(p_brand, '([0-9]+)$', 1)"
ORACLES = {
    "call_sites": """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_returnflag AS f, 10 + sum(CASE l_returnflag WHEN 'N' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag ROWS UNBOUNDED PRECEDING) AS site FROM lineitem),
b AS (SELECT o, p, min(site) AS site FROM l GROUP BY 1, 2)
SELECT DISTINCT 'order:' || o AS src, 'part:' || p AS dst, site::BIGINT AS site, CASE f WHEN 'A' THEN 'if' WHEN 'R' THEN 'loop' END AS branch FROM b JOIN l USING (o, p, site)""",
    "flow_entries": """WITH c AS (SELECT l_orderkey AS o FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2)
SELECT 'order:' || o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'route' WHEN o_orderstatus = 'F' THEN 'test' ELSE 'entry' END AS kind, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_orderpriority END AS route
FROM orders WHERE o_orderkey IN (SELECT o FROM c) OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""",
    "flow_steps": f"WITH RECURSIVE {_TRADE_SQL} SELECT entry, step::INT AS step, id, depth::INT AS depth, parent::INT AS parent, site FROM t",
    "flow_list": f"{_LIST_SQL} SELECT * FROM fl",
    "flow_domains": f"""{_LIST_SQL}, d AS (SELECT domain, path FROM fl JOIN t USING (entry) JOIN nodes USING (id)),
x AS (SELECT domain, count(DISTINCT path) AS files, string_split(min(path), '/') AS lo, string_split(max(path), '/') AS hi FROM d GROUP BY 1)
SELECT domain, CASE WHEN lo[2] = hi[2] AND len(lo) > 2 AND len(hi) > 2 THEN 'src/' || lo[2] ELSE 'src' END AS label, flows, files FROM x JOIN (SELECT domain, count(*) AS flows FROM fl GROUP BY 1) USING (domain)""",
    "source_definitions": """WITH s AS (SELECT 's' || s_suppkey || '.py' AS path, s_suppkey AS k, s_nationkey AS n, length(s_suppkey::VARCHAR) AS w, length(s_nationkey::VARCHAR) AS v FROM supplier),
r AS (SELECT 'n' || n_nationkey || '.rs' AS path, n_nationkey AS k, length(n_nationkey::VARCHAR) AS w FROM nation)
SELECT path, 'class' AS kind, 'S' || k AS name, NULL AS owner, 2 AS first, 8 AS last, (144 + 3 * w + v)::BIGINT AS bytes FROM s UNION ALL SELECT path, 'method', 'sell_' || k, 'S' || k, 4, 5, 63 + w + v FROM s
UNION ALL SELECT path, 'method', 'pay', 'S' || k, 7, 8, 38 FROM s UNION ALL SELECT path, 'function', 'main', NULL, 9, 10, 27 + 2 * w FROM s
UNION ALL SELECT path, 'class', 'N' || k, NULL, 2, 2, 22 + w FROM r UNION ALL SELECT path, 'impl', 'N' || k, NULL, 3, 7, 79 + 2 * w FROM r UNION ALL SELECT path, 'method', 'run', 'N' || k, 4, 6, 68 + w FROM r
UNION ALL SELECT 'r' || r_regionkey || '.vue', 'function', 'v' || r_regionkey, NULL, 4, 6, 30 + 2 * length(r_regionkey::VARCHAR) FROM region""",
    "source_calls": """SELECT 's' || s_suppkey || '.py' AS path, 5 AS line, 'self' AS receiver, 'pay' AS name FROM supplier UNION ALL SELECT 's' || s_suppkey || '.py', 5, NULL, 'f' || s_nationkey FROM supplier
UNION ALL SELECT 's' || s_suppkey || '.py', 10, NULL, 'S' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey || '.py', 10, '()', 'sell_' || s_suppkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey || '.rs', 5, 'inner', 'leaf_' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey || '.vue', 5, NULL, 'w' || r_regionkey FROM region""",
    "source_imports": """SELECT 's' || s_suppkey || '.py' AS path, 'python' AS lang, '.n' || s_nationkey AS raw FROM supplier UNION ALL SELECT 'n' || n_nationkey || '.rs', 'rust', 'crate::r' || n_regionkey || '::go' FROM nation
UNION ALL SELECT 'r' || r_regionkey || '.vue', 'vue', './r' || r_regionkey FROM region""",
    "script_blocks": """SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS bytes, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]*>(.*?)(?:</script|$)', 1), lambda s: length(regexp_replace(s, '[ \\n]', '', 'g')))), 0)::BIGINT AS letters FROM pages""",
    "declared_models": f"""SELECT 'app/Shop' || s_suppkey || '/models/m.py' AS path, 'shop' || s_suppkey || '_supplier' || s_suppkey AS "table", 'Supplier' || s_suppkey AS model FROM supplier
UNION ALL SELECT 'app/Shop' || s_suppkey || '/models/m.py', 'other_' || s_nationkey, 'Other' || s_suppkey FROM supplier UNION ALL SELECT 'p' || p_partkey || '.py', 'part_' || {_NO}, 'A' || p_partkey FROM part
UNION ALL SELECT 'p' || p_partkey || '.ts', 'b' || {_NO} || '_t' || p_partkey, 't' || p_partkey FROM part UNION ALL SELECT 'p' || p_partkey || '.ts', 'brand_' || {_NO}, NULL FROM part
UNION ALL SELECT 'n' || n_nationkey || '.prisma', 'n_' || n_regionkey, 'Nation' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey || '.prisma', 'pet' || n_nationkey, 'Pet' || n_nationkey FROM nation""",
    "alias_imports": """SELECT a.p_partkey::VARCHAR AS site, 'web/b/p' || b.p_partkey || '/index.ts' AS target, 2 AS tier FROM part a JOIN part b ON b.p_partkey = CASE WHEN a.p_partkey % 2 = 0 THEN a.p_partkey // 2 ELSE a.p_partkey // 3 END""",
    "team_scopes": """WITH r AS (SELECT 'n' || c_nationkey || '/c' || c_custkey AS path, c_nationkey AS n FROM customer WHERE c_acctbal > 9900)
SELECT n_name AS seat, path AS prefix FROM nation JOIN r ON n_regionkey = 0 OR n = n_nationkey UNION ALL SELECT n_name, CASE WHEN n_regionkey = 0 THEN '.' ELSE 'n' || n_nationkey || '/' END FROM nation
WHERE NOT EXISTS (SELECT 1 FROM r WHERE n_regionkey = 0 OR n = n_nationkey)""",
    # all pairs of a region are handed off by rank, so of each pair the first one's holds
    "team_deps": "SELECT b.n_name AS id, a.n_name AS needs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
}
#: ``folder_groups`` goes by repeated splits, which are tested against plain code
QUERIES = {name: globals()[name] for name in (*ORACLES, "folder_groups")}
