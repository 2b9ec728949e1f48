"""Calls proven through scoped paths and typed locals, uses of tables, on sources written from the given tables; communities and cycles of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import communities, ledger, levels, linking, policy, resolution, scoped
from weftgraph.plans.graph_queries import _MATRIX
from weftgraph.plans.policy_queries import _V, RULES
from weftgraph.plans.resolution_queries import _NO, _name
from weftgraph.session import cut, read_table, spread, stored, wide
from weftgraph.sources import bindings, code_files, definitions, rust_paths, table_use
from weftgraph.sources.projection import nation_flows

_NATION = """mod deep;
pub use self::deep::leaf as l%1$s;
pub struct T%1$s;
impl T%1$s {
    pub fn make(x: u8) -> u8 { Self::kept(x) }
    fn kept(x: u8) -> u8 { x }
}
pub fn f%1$s() -> u8 { 2 }
"""
_SUPPLIER = """use crate::n%1$s::{T%1$s as T, deep::{self, leaf as low}};
fn run() {
    crate::n%1$s::f%1$s();
    n%1$s::f%1$s();
    T::make(1); low();
    deep::leaf();
    crate::n%1$s::l%1$s();
    super::n%2$s::deep::leaf();
    crate::none::f(); // low()
}
"""


def _crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crate with a module a nation, each with one below it, and a file a supplier that uses its nation's."""
    nation, supplier = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")
    root = nation.agg(F.array_join(F.sort_array(F.collect_list(_name("pub mod n%s;", "n_nationkey"))), "\n").alias("text"))  # a line a nation
    files = root.select(F.lit("k/src/lib.rs").alias("path"), "text").union(nation.select(_name("k/src/n%s.rs", "n_nationkey"), _name(_NATION, "n_nationkey")))
    files = files.union(nation.select(_name("k/src/n%s/deep.rs", "n_nationkey"), F.lit("pub fn leaf() {}\n")))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    files = files.union(rows.select(_name("k/src/s%s.rs", "s_suppkey"), _name(_SUPPLIER, "s_nationkey", "n_regionkey")))
    return files.select("path", F.lit("rust").alias("lang"), "text")


def scoped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the paths that suppliers and nations call lead."""
    files = _crate(spark, sf_dir)
    defs = cut(definitions.definitions(files).where("kind in ('function', 'method')").select(F.concat("path", F.lit(":"), "name").alias("id"), "path", "name", F.when(F.col("kind") == "method", F.col("owner")).alias("owner")))
    calls = scoped.own_paths(rust_paths.called_paths(files).join(definitions.line_scopes(files), ["path", "line"]))
    return scoped.scoped_targets(calls.select("path", "asked"), files, defs, rust_paths.uses(files), rust_paths.declared_modules(files))


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each module of the crate, by its folder."""
    files = _crate(spark, sf_dir)
    return scoped.modules(files, rust_paths.declared_modules(files))


_ENV = """# NO_%1$s=1
NATION_%1$s=1
 KEY_%2$s = x
bad key=1

BARE_%2$s
"""


def env_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example of environment keys a supplier."""
    s = read_table(spark, sf_dir, "supplier")
    return code_files.env_example(s.select(_name("s%s/.env.example", "s_suppkey").alias("path"), _name(_ENV, "s_nationkey", "s_suppkey").alias("text")))


def merged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls: finished ones are proven, urgent ones inferred through an interface, and all have a guess by name."""
    o = read_table(spark, sf_dir, "orders").withColumn("site", F.col("o_orderkey"))
    named = o.select("site", F.col("o_orderpriority").alias("id"), F.lit(0.5).alias("weight"), F.lit(0).alias("tier"))
    return resolution.merged_calls(o.where("o_orderstatus = 'F'").select("site", F.lit("proven").alias("id")), o.where("o_orderpriority = '1-URGENT'").select("site", F.lit("soft").alias("id")), named)


_BRAND = """export class B%1$s {
  price() {
    return 1;
  }
}
"""
_PART = """import { B%1$s } from './b%1$s'
import { B%2$s } from './b%2$s'
const b = new B%1$s();
function outer() {
  function inner() {
    return b.price();
  }
  return inner();
}
function near(b: B%2$s) {
  const deep = () => {
    return b.price();
  }
  return deep();
}
function dark() {
  const b = made();
  return b.price();
}
"""


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"))
    no = F.regexp_extract("p_brand", r"(\d+)$", 1)
    other = F.concat((F.col("p_size") % 5 + 1).cast("string"), (F.col("p_partkey") % 5 + 1).cast("string"))
    files = part.select(_name("web/b%s.ts", no).alias("path"), _name(_BRAND, no).alias("text")).distinct().union(part.select(_name("web/p%s.ts", "p_partkey"), _name(_PART, no, other)))
    return files.select("path", F.lit("typescript").alias("lang"), "text")


def typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of locals whose type the nearest scope tells: the part's brand, or another one that a parameter has; and the class itself."""
    files = _web(spark, sf_dir)
    found = stored(definitions.definitions(files).select("path", "kind", "name", "owner"))
    whole = lambda name: F.concat("path", F.lit(":"), name)
    defs = found.select(whole(F.concat_ws(".", F.when(F.col("kind") == "method", F.col("owner")), F.col("name"))).alias("id"), "path", "name", F.when(F.col("kind") == "method", whole(F.col("owner"))).alias("owner"))
    scopes = stored(definitions.line_scopes(files))
    named = stored(bindings.named_imports(files).withColumn("site", F.concat_ws("|", "path", "raw")))
    targets = resolution.import_files(named.select("site", "path", "lang", "raw").distinct(), files.select("path"))
    bound = named.join(wide(targets), "site").select("path", "local", "target", "exported")
    calls = stored(_sites(files, scopes))
    locals_ = bindings.bound_locals(files).join(wide(scopes.select("path", "line", "scope")), ["path", "line"]).select("path", "scope", "local", "type")
    types = resolution.visible_types(calls.where("receiver is not null").select("path", "scope", "chain", F.col("receiver").alias("local")), locals_)
    bases, again = spark.createDataFrame([], "owner string, base string"), spark.createDataFrame([], "path string, name string, target string, exported string")
    return resolution.structured_calls(calls, defs, bound, bases, types, again)


def _sites(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Calls with their scopes."""
    calls = definitions.call_names(files).withColumnRenamed("name", "called")
    rows = calls.join(wide(scopes), ["path", "line"])
    owner = F.when(F.col("owner").isNotNull(), F.concat("path", F.lit(":"), "owner"))
    return rows.select(F.concat_ws(":", "path", "line").alias("site"), "path", "scope", "chain", owner.alias("owner"), "receiver", F.col("called").alias("name"))


_MODELS = """from sqlalchemy.orm import declarative_base
class Nat%1$s(Base):
    __tablename__ = "nation_%1$s"
"""
_USER = """from db.n%1$s import Nat%1$s as Home
def listed(s):
    return s.query(Home).all() # Nat%1$s
def told(s):
    x = "select * from shop_%2$s join nation_%1$s on true"
    return Nat%1$s
"""
_FAKE = """class Nat%1$s:
    pass
def noise(d, shop_%2$s):
    d.update(shop_%2$s)
    return Nat%1$s()
"""


def used_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers use their nation's model and table and their own script's; customers have classes of the same name and use nothing."""
    s, n, c = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    s, c = spread(s.select("s_suppkey", "s_nationkey")), spread(c.select("c_custkey", "c_nationkey"))
    files = n.select(_name("db/n%s.py", "n_nationkey").alias("path"), F.lit("python").alias("lang"), _name(_MODELS, "n_nationkey").alias("text"))
    files = files.union(s.select(_name("db/shop_%s.sql", "s_suppkey"), F.lit("sql"), _name("CREATE TABLE shop_%s (a int);", "s_suppkey")))
    files = files.union(s.select(_name("py/s%s.py", "s_suppkey"), F.lit("python"), _name(_USER, "s_nationkey", "s_suppkey")))
    return table_use.table_uses(files.union(c.select(_name("fake/c%s.py", "c_custkey"), F.lit("python"), _name(_FAKE, "c_nationkey", "c_custkey"))))


_TAKES = """import os
import nation_%1$s
from Sup_%2$s.x import y
import n%1$s
from . import z
"""
_WEB = """import a from 'brand%1$s/sub'
import fs from 'node:fs'
import path from "path"
import b from '@x/p%2$s'
import './q'
"""


def undeclared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts import declared, undeclared, runtime and own modules; manifests also declare what nobody uses."""
    s, n, p = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "part"))
    no = F.regexp_extract("p_brand", r"(\d+)$", 1)
    files = s.select(_name("py/s%s.py", "s_suppkey").alias("path"), F.lit("python").alias("lang"), _name(_TAKES, "s_nationkey", "s_suppkey").alias("text"))
    files = files.union(n.select(_name("py/n%s.py", "n_nationkey"), F.lit("python"), F.lit(""))).union(p.select(_name("web/p%s.ts", "p_partkey"), F.lit("typescript"), _name(_WEB, no, "p_partkey")))
    manifests = s.select(_name("s%s/requirements.txt", "s_suppkey").alias("path"), _name("nation-%s>=2\nidle_%s", "s_nationkey", "s_suppkey").alias("text"))
    manifests = manifests.union(p.select(_name("b%s/package.json", no), _name('{"dependencies": {"brand%s": "1"}}', no)).distinct())
    imports = cut(definitions.imports(files).withColumn("site", F.concat_ws("|", "path", "raw")))
    targets = resolution.import_files(imports.select("site", "path", "lang", "raw"), files.select("path"))
    return linking.package_report(imports, targets, code_files.manifest_deps(manifests).select("ecosystem", "name"))


_CARGO = """[package]
name = "n%1$s"
[[bin]]
name = "run%1$s"
path = "tools/r%1$s.rs"
[[bin]]
name = 'plain%1$s'
[dependencies]
name = "none"
"""
_PYPROJECT = """[project]
name = "s%1$s"
[project.scripts]
go%1$s = "pkg.cli:main%1$s"
bare%1$s = "pkg.other"
[tool.x]
no = "a:b"
"""


def declared_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of nations and suppliers; only suppliers with an even number have the file of theirs."""
    s, n = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    files = n.select(_name("n%s/Cargo.toml", "n_nationkey").alias("path"), _name(_CARGO, "n_nationkey").alias("text"))
    files = files.union(s.select(_name("s%s/pyproject.toml", "s_suppkey"), _name(_PYPROJECT, "s_suppkey"))).union(s.where("s_suppkey % 2 = 0").select(_name("s%s/src/pkg/cli.py", "s_suppkey"), F.lit("")))
    return code_files.declared_entries(files)


def guarded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders change the lines of their parts in the files of brands; a part has 50 lines and its name."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.lit("part"), "p_type", "p_brand").alias("path"), F.col("p_name").alias("symbol"))
    spans = part.select("path", "symbol", (F.col("p_partkey") * 100).alias("first"), (F.col("p_partkey") * 100 + 49).alias("last"))
    lines = read_table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    start = F.col("l_partkey") * 100 + F.col("l_linenumber")
    ranges = lines.select(F.col("l_orderkey").alias("change"), "path", start.alias("ra"), (start + F.col("l_quantity").cast("long")).alias("rb"))
    return policy.touched_verdicts(ranges, spans, policy.with_own(RULES))


def ledger_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the states of a slice: errors are refusals, signups rejections, large ones for their tests."""
    events = read_table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "passed").when(F.col("event_type") == "signup", "rejected").otherwise("queued")
    rows = events.select((F.col("user_id") % 20).alias("run"), F.col("user_id").alias("slice"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), state.alias("state"), "event_type", "value")
    changes = rows.where("event_type <> 'error'").select("run", "slice", "at", "state", F.when((F.col("state") == "rejected") & (F.col("value") > 300), "Tests failed").alias("reason"), F.floor("value").alias("tokens"), F.lit(0.0).alias("cost"))
    return ledger.ledger_seats(changes, rows.where("event_type = 'error'"))


def run_synopses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 letters of what became of each run."""
    return ledger.one_page(ledger.synopses(ledger_seats(spark, sf_dir)), "run", 300)


def ledger_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type as a run's copy: clicks of every third user are files."""
    last = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), "event_type").agg(F.max("event_id").alias("ended"))
    mine = (F.col("event_type") == "click") & (F.col("id") % 3 == 0)
    return ledger.ledger_copies(last.where(mine), last.where(~mine))


def _coupled(matrix: DataFrame, share: float) -> DataFrame:
    """Nation pairs with more lines than ``share`` times the mean pair."""
    return matrix.join(F.broadcast(matrix.agg(F.avg("n").alias("mean"))), F.col("n") > share * F.col("mean")).drop("mean")


def communities_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of nations that trade much, each nation by id until none moves."""
    strong = _coupled(cut(levels.matrix(nation_flows(spark, sf_dir))), 1.8)
    return communities.communities(strong.select("src", "dst", F.col("n").cast("double").alias("weight")))


def gate_new_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of nations that trade much which those that trade more don't have."""
    matrix = cut(levels.matrix(nation_flows(spark, sf_dir)))
    new = communities.new_cycles(_coupled(matrix, 1.3), _coupled(matrix, 1.5))
    return new.withColumn("loop", F.array_join("loop", ">"))


_NEAR = "adj[k % n + 1]"
_OWN = "lab[k % n + 1]"
_SCORE = f"round(list_sum(list_transform({_NEAR}, lambda x: CASE WHEN lab[x.b] = c THEN x.w ELSE 0 END)) + CASE WHEN {_OWN} = c THEN 0.05 ELSE 0 END, 6)"
_REACH = "SELECT src, dst FROM {0} UNION SELECT {1}.src, {0}.dst FROM {1} JOIN {0} ON {1}.dst = {0}.src"
_CLASSES = "SELECT id, min(least(id, other)) AS component FROM (SELECT x.src AS id, x.dst AS other FROM {0} x JOIN {0} y ON x.src = y.dst AND x.dst = y.src) GROUP BY 1"
_SEATS_SQL = """WITH e AS (SELECT user_id % 20 AS run, user_id AS slice, epoch_us(ts) // 1000 AS t, event_type, value FROM events),
c AS (SELECT run, slice, arg_max(event_type, t) AS last, count(*) FILTER (event_type = 'click') AS attempts, bool_or(event_type = 'signup' AND value > 300) AS blamed, sum(floor(value))::BIGINT AS tokens, max(t) - min(t) AS duration_ms FROM e WHERE event_type <> 'error' GROUP BY 1, 2),
r AS (SELECT slice, count(*) AS refusals FROM e WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT run, c.slice, CASE last WHEN 'purchase' THEN 'passed' WHEN 'signup' THEN 'rejected' ELSE 'failed' END AS verdict, CASE WHEN last = 'purchase' THEN true WHEN blamed THEN false END AS tests, attempts,
  coalesce(refusals, 0) AS refusals, tokens, 0.0::DOUBLE AS cost, duration_ms, last = 'purchase' AS passed FROM c LEFT JOIN r USING (slice))
SELECT *, round(40.0::DOUBLE * passed::INT + 20.0 * coalesce(tests, passed)::INT + 15.0 * (1.0::DOUBLE / (1 + refusals)) + 10.0 * (1.0::DOUBLE / greatest(attempts, 1)) + 10.0 * (CASE WHEN tokens = 0 THEN 0.5 ELSE 1.0::DOUBLE / (1 + tokens / 200000.0::DOUBLE) END)
  + 5.0 * (1.0::DOUBLE / (1 + duration_ms / 1800000.0::DOUBLE)), 1) AS score FROM s"""
_LINES = "(VALUES ('crate::n%::f%', 0, 'f%'), ('n%::f%', 0, 'f%'), ('T::make', 0, 'make'), ('low', 1, 'leaf'), ('deep::leaf', 1, 'leaf'), ('crate::n%::l%', 1, 'leaf')) AS l(asked, deep, name)"
ORACLES = {
    "scoped_targets": f"""SELECT 'k/src/s' || s_suppkey || '.rs' AS path, replace(asked, '%', s_nationkey::VARCHAR) AS asked, 'k/src/n' || s_nationkey || CASE WHEN deep = 1 THEN '/deep' ELSE '' END || '.rs:' || replace(name, '%', s_nationkey::VARCHAR) AS id FROM supplier, {_LINES}
UNION ALL SELECT 'k/src/s' || s_suppkey || '.rs', 'super::n' || n_regionkey || '::deep::leaf', 'k/src/n' || n_regionkey || '/deep.rs:leaf' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'k/src/n' || n_nationkey || '.rs', 'T' || n_nationkey || '::kept', 'k/src/n' || n_nationkey || '.rs:kept' FROM nation""",
    "communities_in_order": f"""WITH RECURSIVE {_MATRIX}, s AS (SELECT * FROM m WHERE n > 1.8::DOUBLE * (SELECT avg(n) FROM m)),
arcs AS (SELECT src, dst, sum(n)::DOUBLE AS w FROM (SELECT src, dst, n FROM s UNION ALL SELECT dst, src, n FROM s) GROUP BY 1, 2),
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT DISTINCT src AS id FROM arcs)),
g AS (SELECT list(l ORDER BY i) AS adj, count(*) AS n FROM (SELECT x.i, list({{'b': y.i, 'w': w}}) AS l FROM arcs JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst GROUP BY 1)),
walk AS (SELECT 0::BIGINT AS k, range(1, n + 1) AS lab, false AS moved, false AS stop FROM g UNION ALL
  SELECT k + 1, list_concat(lab[:k % n], [best], lab[k % n + 2:]), CASE WHEN (k + 1) % n = 0 THEN false ELSE moved OR best <> {_OWN} END, (k + 1) % n = 0 AND (NOT (moved OR best <> {_OWN}) OR (k + 1) // n = 24)
  FROM (SELECT walk.*, g.*, list_min(list_transform(list_distinct(list_append(list_transform({_NEAR}, lambda x: lab[x.b]), {_OWN})), lambda c: {{'s': -{_SCORE}, 'c': c}})).c AS best FROM walk, g WHERE NOT stop))
SELECT a.id, b.id AS label, (k // n)::INT AS rounds FROM walk, g, nodes a JOIN nodes b ON true WHERE stop AND b.i = lab[a.i]""",
    "gate_new_cycles": f"""WITH RECURSIVE {_MATRIX}, s AS (SELECT * FROM m WHERE n > 1.3::DOUBLE * (SELECT avg(n) FROM m)), t AS (SELECT * FROM m WHERE n > 1.5::DOUBLE * (SELECT avg(n) FROM m)),
rs AS ({_REACH.format("s", "rs")}), rt AS ({_REACH.format("t", "rt")}), cs AS ({_CLASSES.format("rs")}), ct AS ({_CLASSES.format("rt")}),
new AS (SELECT component, count(*) AS members, list(id ORDER BY id) AS ids FROM cs GROUP BY 1 HAVING count(*) > 1 AND list(id ORDER BY id) NOT IN (SELECT list(id ORDER BY id) FROM ct GROUP BY component)),
w AS (SELECT component, component AS node, [component] AS way FROM new UNION ALL
  SELECT w.component, s.dst, min(list_append(way, s.dst)) FROM w JOIN s ON s.src = w.node AND s.src <> s.dst JOIN cs ON cs.id = s.dst AND cs.component = w.component WHERE len(way) < 12 AND (len(way) = 1 OR w.node <> w.component) GROUP BY 1, 2),
f AS (SELECT component, way AS loop FROM w WHERE node = component AND len(way) > 1 QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(way), way) = 1)
SELECT component, members, array_to_string(loop, '>') AS loop FROM new JOIN f USING (component)""",
    "undeclared_packages": f"""SELECT 'pypi' AS ecosystem, 'nation_' || s_nationkey AS name, count(*) AS files, 'used' AS state FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 'pypi', 'idle_' || s_suppkey, 0, 'unused' FROM supplier UNION ALL SELECT 'pypi', 'sup_' || s_suppkey, 1, 'undeclared' FROM supplier
UNION ALL SELECT 'npm', 'brand' || {_NO}, count(*), 'used' FROM part GROUP BY p_brand UNION ALL SELECT 'npm', '@x/p' || p_partkey, 1, 'undeclared' FROM part""",
    "ledger_seats": _SEATS_SQL,
    "run_synopses": f"""WITH q AS ({_SEATS_SQL}),
l AS (SELECT run, 0::BIGINT AS no, count(*) FILTER (passed) || ' of ' || count(*) || ' seats passed, score ' || printf('%.1f', round(avg(score), 1)) || CASE WHEN sum(tokens) > 0 THEN ', ' || sum(tokens) || CASE WHEN sum(tokens) = 1 THEN ' token' ELSE ' tokens' END ELSE '' END AS text FROM q GROUP BY 1
UNION ALL SELECT run, row_number() OVER (PARTITION BY run ORDER BY slice), slice || ' ' || verdict || CASE WHEN attempts > 1 THEN ', ' || attempts || ' attempts' ELSE '' END
  || CASE WHEN refusals > 0 THEN ', ' || refusals || CASE refusals WHEN 1 THEN ' refusal' ELSE ' refusals' END || ' by fences' ELSE '' END || CASE WHEN NOT coalesce(tests, true) THEN ', tests failed' ELSE '' END FROM q
UNION ALL SELECT run, count(*) + 1, 'Fences held on ' || string_agg(CASE WHEN refusals > 0 THEN slice::VARCHAR END, ', ' ORDER BY slice) FROM q GROUP BY 1 HAVING sum(refusals) > 0)
SELECT run, no, text FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY run ORDER BY no) - 1 AS upto FROM l) WHERE upto <= 300""",
    "declared_entries": """SELECT 'run' || n_nationkey AS symbol, 'n' || n_nationkey || '/tools/r' || n_nationkey || '.rs' AS file FROM nation UNION ALL SELECT 'plain' || n_nationkey, 'n' || n_nationkey || '/src/bin/plain' || n_nationkey || '.rs' FROM nation
UNION ALL SELECT 'main' || s_suppkey, 's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '/src/pkg/cli.py' ELSE '/pyproject.toml' END FROM supplier UNION ALL SELECT 'bare' || s_suppkey, 's' || s_suppkey || '/pyproject.toml' FROM supplier""",
    "guarded_edits": f"""WITH {_V} SELECT l_orderkey AS change, path, count(DISTINCT symbol) AS symbols, max(level) AS level, coalesce(arg_max(rule, level * 10 - CASE rule WHEN 'economy' THEN 0 WHEN 'bolts' THEN 1 WHEN 'first brands' THEN 2 WHEN 'tenth brands' THEN 3 ELSE 9 END), '-') AS rule
FROM lineitem JOIN v ON v.id = 'part:' || l_partkey GROUP BY 1, 2""",
    "ledger_copies": """WITH l AS (SELECT user_id AS id, event_type, max(event_id) AS ended FROM events GROUP BY 1, 2)
SELECT id, event_type, ended FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY (event_type = 'click' AND id % 3 = 0) DESC, ended DESC, event_type DESC) = 1""",
    "used_models": """SELECT 'py/s' || s_suppkey || '.py' AS path, unnest(['listed', 'told', 'told']) AS symbol, unnest(['nation_' || s_nationkey, 'nation_' || s_nationkey, 'shop_' || s_suppkey]) AS "table", unnest([3, 5, 5])::INT AS line FROM supplier""",
    "module_files": """SELECT 'k/src' AS base, 'k/src/lib.rs' AS file UNION ALL SELECT 'k/src/n' || n_nationkey, 'k/src/n' || n_nationkey || '.rs' FROM nation
UNION ALL SELECT 'k/src/n' || n_nationkey || '/deep', 'k/src/n' || n_nationkey || '/deep.rs' FROM nation UNION ALL SELECT 'k/src/s' || s_suppkey, 'k/src/s' || s_suppkey || '.rs' FROM supplier""",
    "env_templates": """SELECT 's' || s_suppkey || '/.env.example' AS path, unnest(['NATION_' || s_nationkey, 'KEY_' || s_suppkey, 'BARE_' || s_suppkey]) AS key, unnest([2, 3, 6])::BIGINT AS line FROM supplier""",
    "merged_targets": """SELECT o_orderkey AS site, CASE WHEN o_orderstatus = 'F' THEN 'proven' WHEN o_orderpriority = '1-URGENT' THEN 'soft' ELSE o_orderpriority END AS id,
  CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS tier FROM orders""",
    "typed_calls": """WITH p AS (SELECT p_partkey AS k, regexp_extract(p_brand, '([0-9]+)$', 1) AS b, (p_size % 5 + 1)::VARCHAR || (p_partkey % 5 + 1)::VARCHAR AS c FROM part)
SELECT 'web/p' || k || '.ts:3' AS site, 'web/b' || b || '.ts:B' || b AS id, 2 AS rule FROM p
UNION ALL SELECT 'web/p' || k || '.ts:6', 'web/b' || b || '.ts:B' || b || '.price', 4 FROM p
UNION ALL SELECT 'web/p' || k || '.ts:12', 'web/b' || c || '.ts:B' || c || '.price', 4 FROM p WHERE c IN (SELECT b FROM p)""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
