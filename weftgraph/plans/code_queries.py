"""Source readers over sources that are written from rows of the given tables: one file a supplier, part, nation or order.

The SQL states what the rows say, without writing or reading a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import linking
from weftgraph.session import read_table
from weftgraph.sources import code_files, route_scan
from weftgraph.sources.projection import key

_PY = """import os
NATION = os.getenv("NATION_%2$s")
requests.get('/api/suppliers/%1$s')
@app.route("/suppliers/%1$s", methods=["GET", 'post'])
@login
def supplier_%1$s():
    return os.environ["KEY_%2$s"]
@router.delete('/suppliers/%1$s')
async def drop_%1$s():
    pass"""
_TS = """const b = process.env.BRAND_%2$s;
fetch("/api/parts/%1$s");
app.get("/parts/%1$s", views.show%2$s);
app.post('/parts/%1$s', async (req) => {});
router.put("/parts/%1$s", auth(), change);
export async function GET() {}"""
_GO = """os.Getenv("REGION_%2$s")
r.HandleFunc("/nations/%1$s", show).Methods("PUT")
r.GET("/regions/%2$s", region)
r.Handle("/none/%1$s", nil)"""
_RS = """std::env::var("REGION_%2$s");
let app = Router::new().route("/nations/%1$s", get(views::nation).post(views::add));"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, n = (read_table(spark, sf_dir, t) for t in ("supplier", "part", "nation"))

    def written(df: DataFrame, path: str, lang: str, text: str, a: str, b) -> DataFrame:
        a, b = F.col(a).cast("string"), b.cast("string")
        return df.select(F.format_string(path, a).alias("path"), F.lit(lang).alias("lang"), F.format_string(text, a, b).alias("text"))

    brand = F.regexp_extract("p_brand", r"(\d+)$", 1)
    parts = [written(s, "py/s%1$s.py", "python", _PY, "s_suppkey", F.col("s_nationkey")), written(p, "web/app/p%1$s/route.ts", "typescript", _TS, "p_partkey", brand),
             written(n, "go/n%1$s.go", "go", _GO, "n_nationkey", F.col("n_regionkey")), written(n, "rs/n%1$s.rs", "rust", _RS, "n_nationkey", F.col("n_regionkey"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def env_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files.env_reads(_sources(spark, sf_dir))


def fetched_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files.fetched_paths(_sources(spark, sf_dir))


def declared_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_scan.routes(_sources(spark, sf_dir))


def source_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files whose endings go by status and number."""
    end = F.element_at(F.array(*map(F.lit, (".py", ".blade.php", ".RS", ".unknown", ".m"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("src/o.x"), F.col("o_orderkey").cast("string"), end).alias("path"), F.when(F.col("o_orderstatus") == "F", "#import <a>").otherwise("x = 1;").alias("text"))
    lang = F.when(F.col("path").endswith(".m"), "matlab").otherwise(code_files.language(F.col("path")))
    return rows.select("o_orderkey", F.coalesce(code_files.settle(lang, F.col("text")), F.lit("-")).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in each of five formats a nation and supplier."""
    n, s = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    npm = n.select(F.format_string("n%s/package.json", k).alias("path"), F.format_string('{"dependencies": {"region-%s": "1"}, "devDependencies": {"nation-%s": "2"}}', r, k).alias("text"))
    go = n.select(F.format_string("n%s/go.mod", k), F.format_string("module x\nrequire (\n  host/region/r%s/sub v1\n)\nrequire host/nation/n%s v2", r, k))
    k, r = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    plain = s.select(F.format_string("s%s/requirements-dev.txt", k), F.format_string("# all\nnation-%s>=2\n-r other.txt\nsupplier_%s", r, k))
    toml = s.select(F.format_string("s%s/pyproject.toml", k), F.format_string('[project]\ndependencies = ["nation%s>=1"]\n[tool.poetry.dependencies]\npython = "3"\nsup-%s = "1"', r, k))
    return code_files.manifest_deps(npm.union(go).union(plain).union(toml))


def patch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch an order: a hunk a line, of its quantity, on the file of its part."""
    rows = read_table(spark, sf_dir, "lineitem")
    hunk = F.format_string("diff --git a/p%1$s b/p%1$s\n--- a/p%1$s\n+++ b/p%1$s\n@@ -1,2 +%2$s,%3$s @@\n+x", F.col("l_partkey").cast("string"), (F.col("l_linenumber") * 100).cast("string"), F.col("l_quantity").cast("int").cast("string"))
    patches = rows.groupBy(F.col("l_orderkey").alias("patch")).agg(F.array_join(F.collect_list(hunk), "\n").alias("text"))  # an order has a few lines
    return code_files.changed_ranges(patches)


def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    line = F.concat_ws("\t", F.when(F.col("l_returnflag") == "N", "-").otherwise(F.col("l_quantity").cast("int").cast("string")), F.col("l_linenumber").cast("string"), F.concat(F.when(F.col("l_linestatus") == "F", "private/").otherwise("p/"), F.col("l_partkey").cast("string")))
    patches = rows.groupBy(F.col("l_orderkey").alias("patch")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return code_files.numstat(patches, ("private",))


def alias_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers re-export the one with a quarter of their number, from 16 on."""
    rows = read_table(spark, sf_dir, "customer").where("c_custkey >= 16")
    return linking.chase(rows.select(key("customer", "c_custkey").alias("name"), F.concat(F.lit("customer:"), F.expr("c_custkey div 4").cast("string")).alias("target")))


def inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations hold the segments of their customers with a large balance, and inherit from the nation with half their number."""
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    members = c.where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("id"))
    bases = n.where("n_nationkey > 0").select(F.col("n_nationkey").alias("owner"), F.expr("cast(n_nationkey div 2 as int)").alias("base"))
    return linking.inherited(members, bases)


_BRAND = "regexp_extract(p_brand, '([0-9]+)$', 1)"
ORACLES = {
    "env_keys": f"""SELECT 'py/s' || s_suppkey || '.py' AS path, 'NATION_' || s_nationkey AS key, 2::BIGINT AS line FROM supplier UNION ALL SELECT 'py/s' || s_suppkey || '.py', 'KEY_' || s_nationkey, 7 FROM supplier
UNION ALL SELECT 'web/app/p' || p_partkey || '/route.ts', 'BRAND_' || {_BRAND}, 1 FROM part UNION ALL SELECT 'go/n' || n_nationkey || '.go', 'REGION_' || n_regionkey, 1 FROM nation UNION ALL SELECT 'rs/n' || n_nationkey || '.rs', 'REGION_' || n_regionkey, 1 FROM nation""",
    "fetched_urls": "SELECT 'py/s' || s_suppkey || '.py' AS path, '/api/suppliers/' || s_suppkey AS url, 3::BIGINT AS line FROM supplier UNION ALL SELECT 'web/app/p' || p_partkey || '/route.ts', '/api/parts/' || p_partkey, 2 FROM part",
    "declared_routes": f"""WITH s AS (SELECT 'py/s' || s_suppkey || '.py' AS path, '/suppliers/' || s_suppkey AS url, s_suppkey AS k FROM supplier), p AS (SELECT 'web/app/p' || p_partkey || '/route.ts' AS path, '/parts/' || p_partkey AS url, p_partkey AS k, {_BRAND} AS b FROM part)
SELECT path, 'GET' AS method, url, 'supplier_' || k AS handler FROM s UNION ALL SELECT path, 'POST', url, 'supplier_' || k FROM s UNION ALL SELECT path, 'DELETE', url, 'drop_' || k FROM s
UNION ALL SELECT path, 'GET', url, 'views.show' || b FROM p UNION ALL SELECT path, 'GET', '/p' || k, 'GET' FROM p
UNION ALL SELECT 'go/n' || n_nationkey || '.go', 'PUT', '/nations/' || n_nationkey, 'show' FROM nation UNION ALL SELECT 'go/n' || n_nationkey || '.go', 'GET', '/regions/' || n_regionkey, 'region' FROM nation
UNION ALL SELECT 'rs/n' || n_nationkey || '.rs', 'GET', '/nations/' || n_nationkey, 'nation' FROM nation""",
    "source_languages": "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'blade' WHEN 2 THEN 'rust' WHEN 3 THEN '-' ELSE CASE WHEN o_orderstatus = 'F' THEN 'objc' ELSE 'matlab' END END AS lang, count(*) AS files FROM orders GROUP BY 1",
    "manifest_entries": """SELECT 'n' || n_nationkey || '/package.json' AS path, unnest(['region-' || n_regionkey, 'nation-' || n_nationkey]) AS name, 'npm' AS ecosystem, false AS from_lock FROM nation
UNION ALL SELECT 'n' || n_nationkey || '/go.mod', unnest(['host/region/r' || n_regionkey, 'host/nation/n' || n_nationkey]), 'go', false FROM nation
UNION ALL SELECT 's' || s_suppkey || '/requirements-dev.txt', unnest(['nation-' || s_nationkey, 'supplier_' || s_suppkey]), 'pypi', false FROM supplier
UNION ALL SELECT 's' || s_suppkey || '/pyproject.toml', unnest(['nation' || s_nationkey, 'sup-' || s_suppkey]), 'pypi', false FROM supplier""",
    "patch_ranges": "SELECT l_orderkey AS patch, 'p' || l_partkey AS path, (l_linenumber * 100)::BIGINT AS first, (l_linenumber * 100 + greatest(l_quantity::INT, 1) - 1)::BIGINT AS last FROM lineitem",
    "patch_stats": "SELECT l_orderkey AS patch, count(*) AS paths, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity::INT END)::BIGINT AS added, sum(l_linenumber)::BIGINT AS removed FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1",
    "alias_ends": """WITH RECURSIVE w AS (SELECT c_custkey AS k, c_custkey // 4 AS t, 1 AS steps FROM customer WHERE c_custkey >= 16 UNION ALL SELECT k, t // 4, steps + 1 FROM w WHERE t >= 16 AND steps < 5)
SELECT 'customer:' || k AS name, 'customer:' || t AS target, steps::INT AS steps FROM w WHERE t < 16""",
    "inherited_members": """WITH RECURSIVE m AS (SELECT c_nationkey AS owner, c_mktsegment AS name, min(c_custkey) AS id FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2), u AS (SELECT n_nationkey AS owner, n_nationkey AS up, 0 AS steps FROM nation UNION ALL SELECT owner, up // 2, steps + 1 FROM u WHERE up > 0 AND steps < 5)
SELECT owner, name, id, steps::INT AS steps FROM (SELECT u.owner, m.name, m.id, steps, row_number() OVER (PARTITION BY u.owner, m.name ORDER BY steps, m.id) AS r FROM u JOIN m ON u.up = m.owner) WHERE r = 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
