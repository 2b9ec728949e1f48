"""Queries on module trees, names and predicates over the given tables, and their SQL.

Pages stand for files (``path`` is host and path of the url), their hosts and languages for folders; events of a user
stand for symbols of a file, and their order for lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import levels, linking, maps, memory, naming, policy, search, traversal, triples
from weftgraph.operators.ranking import smallest_k
from weftgraph.plans import graph_queries as g
from weftgraph.plans import policy_queries as p
from weftgraph.plans import record_queries as r
from weftgraph.session import cut, parts_of, read_table, stored
from weftgraph.sources.projection import CALLS_SQL, FLOWS_SQL, calls, contains, key, nation_flows

REFS = ("Customer#000000007", "BUILDING", "no such thing", "INDIA", "customer:3", "AUTOMOBILE:Customer#000000001")
BOX = "*.example.com/en/*|de/|/77|**org/fr/1*"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^.*?://([^?#]*)", 1).alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("lines"))
    return rows.groupBy("path").agg(F.max("lines").alias("lines"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), path.alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("line"), "user_id", "ts", "value")


def nodes_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").where(F.expr("p_size > 40 and p_type <> 'SMALL'")).select(key("part", "p_partkey").alias("id"), F.col("p_name").alias("name"))


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").where("c_custkey = 77").select(key("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, tree = calls(spark, sf_dir), contains(spark, sf_dir)
    ids = edges.select("src").union(edges.select("dst")).union(tree.select("parent")).union(tree.select("child")).distinct()
    nodes = ids.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("src").startswith("order:")).alias("files"))
    return nodes.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))


def communities_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select(key("part", "p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return maps.communities(parts).orderBy(F.desc("size"), "community").limit(10)


def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three members of each class of two-way trade."""
    labels = levels.label_propagation(g._strong(spark, sf_dir).withColumn("weight", F.col("n").cast("double")), 1)
    return smallest_k(labels.select("label", "id"), ["label"], ["id"], 3)


def resolve_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in REFS], "ref string")
    return linking.resolve_one(asked, p._geo(spark, sf_dir))


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages as they would stand in source trees; which of them hold tests."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^.*?://([^?#]*)", 1).alias("p"))
    n = F.col("page_id") % 6
    path = F.when(n == 0, F.concat(F.lit("Tests/"), "p")).when(n == 1, F.concat("p", F.lit(".spec.ts"))).when(n == 2, F.concat(F.lit("src/test_"), F.col("page_id").cast("string")))
    path = path.when(n == 3, F.concat(F.lit("latest/"), "p")).when(n == 4, F.concat("p", F.lit("_test.go"))).otherwise(F.concat(F.lit("test_"), "p"))
    return rows.select("page_id", path.alias("path")).select("page_id", "path", paths.is_test(F.col("path")).alias("test"))


def handler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    name = F.when(n == 0, F.concat(F.lit("handle_"), "event_type")).when(n == 1, F.concat("event_type", F.lit("Handler"))).when(n == 2, F.concat("event_type", F.lit("_handler"))).otherwise(F.concat("event_type", F.lit("handler")))
    rows = read_table(spark, sf_dir, "events").select(name.alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("handler", paths.is_handler(F.col("name")))


def public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that begins with an article and holds a given word."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.where(paths.is_public(F.col("text"), F.lit("tion"), ("The ", "La ", "Die "))).select("doc_id")


def file_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(paths.file_box(F.col("path"), BOX)).select("path")


def common_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^(.*?)://", 1).alias("scheme"), F.regexp_extract("url", r"^.*?://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"^.*?://([^?#]*)", 1).alias("path"))
    by_host = rows.groupBy(F.col("host").alias("of")).agg(paths.common_folder(F.col("path")).alias("folder"))
    return by_host.union(rows.groupBy("scheme").agg(paths.common_folder(F.col("path"))))


def unreadable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.verdicts(p._parts(spark, sf_dir), p.RULES).where(F.col("level") == policy.HIDDEN).select("path").distinct()


def research_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose edit is free or asks for small steps, with their symbols."""
    free = policy.file_verdicts(p._parts(spark, sf_dir), p.RULES).where(F.col("level") <= policy.SCOPE)
    return p._parts(spark, sf_dir).join(free, "path").groupBy("path", "level").agg(F.count(F.lit(1)).alias("symbols"))


def first_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views belong to the first click, buys to the first signup of their user; the rest to the user's file."""
    rows = _symbols(spark, sf_dir)
    wanted = F.when(F.col("name") == "view", "click").when(F.col("name") == "purchase", "signup").otherwise("none")
    owned = maps.first_owner(rows.select("id", "path", wanted.alias("parent_name")), rows.select(F.col("id").cast("string").alias("id"), "path", "name", "line"))
    return owned.groupBy("owner").agg(F.count(F.lit(1)).alias("members"))


def self_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks call the error of their user, if there is just one that day."""
    rows = _symbols(spark, sf_dir).withColumn("owner", F.concat_ws("@", "path", F.to_date("ts").cast("string")))
    return maps.self_targets(rows.where("name = 'click'").select(F.col("id").alias("site"), "owner", F.lit("error").alias("name")), rows.select("id", "owner", "name"))


def route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers name a part by their number; it is first looked for among parts of the brand of their nation's number."""
    parts = read_table(spark, sf_dir, "part").select(key("part", "p_partkey").alias("id"), F.col("p_brand").alias("path"), F.concat_ws(" ", "p_name", "p_size").alias("name"), F.col("p_partkey").alias("line"))
    c = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "part"), F.col("c_custkey") == F.col("p_partkey"))
    routes = c.select(key("customer", "c_custkey").alias("route"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("path"), F.concat_ws(" ", "p_name", "p_size").alias("name"))
    return maps.route_handlers(routes, parts)


def env_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who read which key on which day, once each."""
    rows = read_table(spark, sf_dir, "events").select(key("user", "user_id").alias("reader"), F.get_json_object("props", "$.k").alias("key"), F.to_date("ts").cast("string").alias("line"))
    return rows.where("key is not null").dropDuplicates(["reader", "key", "line"])


def file_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region above every order, counted with the levels climbed."""
    orders = read_table(spark, sf_dir, "orders").select(key("order", "o_orderkey").alias("id"))
    return maps.climb(orders, contains(spark, sf_dir), F.col("at").startswith("region:")).groupBy("top", "levels").agg(F.count(F.lit(1)).alias("n"))


def nodes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _symbols(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    rows = _symbols(spark, sf_dir).select(F.concat_ws("#", "name", F.col("id").cast("string")).alias("id"), "path", "line")
    return maps.near(users, rows, "user/7")


def hand_offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that order parts of a brand after another did: pairs of seats with their shared brands."""
    rows = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    first = rows.groupBy(F.col("p_brand").alias("slice"), F.col("c_mktsegment").alias("seat")).agg(F.min("o_orderdate").alias("at"))
    deps = first.groupBy("slice").agg(F.min(F.struct("at", "seat")).alias("f")).select("slice", F.col("f.seat").alias("from"))
    return first.join(deps, "slice").where("seat <> from").groupBy("from", F.col("seat").alias("to")).agg(F.count(F.lit(1)).alias("slices"))


def loc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders, from order to last shipment, by nation."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("b"))
    rows = read_table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    spans = rows.select(F.col("o_orderkey").alias("id"), day(F.col("o_orderdate")).alias("first_line"), day(F.col("b")).alias("last_line"))
    owner = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), key("nation", "c_nationkey").alias("owner"))
    return maps.sizes(spans, owner)


def churn_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.folder_churn(_files(spark, sf_dir))


def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.module_tree(_files(spark, sf_dir))


def module_tree_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.module_tree(_files(spark, sf_dir)).where("level <= 1 and lines > 0").select("module", "files")


def refusals_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").where("event_type = 'error' and ts >= timestamp_ntz'2024-01-10 00:00:00'").groupBy(F.get_json_object("props", "$.k").alias("slice")).agg(F.count(F.lit(1)).alias("refusals"))


def languages_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    return rows.withColumn("installed", F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False)))


def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), "l_partkey", "l_suppkey", "l_shipdate")
    return naming.stable_keys(rows, "key", ["l_shipdate", "l_partkey", "l_suppkey"]).select("stable", "l_partkey")


def entity_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("urn:sym:"), F.regexp_replace("p_type", " ", "%20"), F.lit("#"), F.regexp_replace("p_name", " ", "%20"))
    rows = read_table(spark, sf_dir, "part").select(base.alias("base"), F.col("p_partkey").alias("line"))
    return naming.entity_iris(rows, "base", "line", ["line"]).select("line", "iri")


def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("label"))
    return naming.unique_labels(rows, "label", ["id"]).select("id", "unique_label")


def class_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("function", "file", "route", "env", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read_table(spark, sf_dir, "events").select("event_id", naming.class_of(kind).alias("class"), naming.date_time(seconds).alias("at"))


def brief_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _symbols(spark, sf_dir).select(F.col("name").alias("kind"), F.col("id").cast("string").alias("name"), F.col("path").alias("file"))
    return maps.capped(rows, {"click": 5, "view": 10})


def experiment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the latest trial before; the trials come in the order of their values, so some are out of time."""
    rows = read_table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return maps.gaps(rows, "user_id", ["value", "event_id"], "at").select("event_id", "gap")


def impact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits by depth and name."""
    return g.impact_upstream(spark, sf_dir).orderBy("depth", "id").limit(50)


def flows_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.flows_reach(spark, sf_dir).orderBy(F.desc("reach"), "entry").limit(20)


def boundary_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.isolate_boundary(spark, sf_dir).orderBy(F.desc("n"), "outside", "direction").limit(20)


def module_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module with the most churn, then fan-in, then the first name."""
    m = levels.matrix(nation_flows(spark, sf_dir))
    own = m.groupBy("dst").agg(F.sum("n").alias("churn"), F.count(F.lit(1)).alias("fan_in"))
    return own.orderBy(F.desc("churn"), F.desc("fan_in"), "dst").limit(1)


def changed_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths changed or new, private ones aside."""
    parts = p._parts(spark, sf_dir)
    changed = parts.where("p_size > 45").select("path", "symbol").union(parts.where("p_size < 3").select("path", "symbol"))
    return policy.visible(changed, p.RULES).select("path").distinct()


def triples_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of containment without those of hidden nations."""
    hidden = read_table(spark, sf_dir, "nation").where("n_regionkey = 2").select(key("nation", "n_nationkey").alias("id"))
    return triples.without(triples.state(calls(spark, sf_dir, src="order:3"), contains(spark, sf_dir), parts=parts_of(read_table(spark, sf_dir, "orders"))), hidden).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def selector_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    chosen = [parts.where("p_brand = 'Brand#3'"), parts.where("p_size = 7"), parts.where("p_name like 'blue%'")]
    return chosen[0].union(chosen[1]).union(chosen[2]).select(key("part", "p_partkey").alias("id")).distinct()


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = p._parts(spark, sf_dir).select(F.col("path").alias("file"), F.col("symbol").alias("name"), "p_size", "p_type")
    found = {"cli": parts.where("name like '%bolt'"), "http": parts.where(paths.is_handler(F.col("name")) | (F.col("p_size") == 1)), "test": parts.where("p_type = 'SMALL' and p_size > 45")}
    return maps.entry_points(found)


def hot_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    fan = lines.groupBy(F.col("p_brand").alias("module"), key("part", "p_partkey").alias("name")).agg(F.count_distinct("l_orderkey").alias("fan_in"))
    churn = read_table(spark, sf_dir, "part").where("p_size > 25").groupBy(F.col("p_brand").alias("module")).agg(F.count(F.lit(1)).alias("churn"))
    return maps.hot_spots(fan, churn)


def module_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.module_report(g._strong(spark, sf_dir))


def closes_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edge from a part, and one from a region, to an order would close a loop."""
    edges = stored(calls(spark, sf_dir).select("src", "dst"))
    rows = [(b, maps.reaches(edges, "order:3", b)) for b in ("supplier:7", "region:1")]
    return spark.createDataFrame(rows, "target string, closes boolean")


def connected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = calls(spark, sf_dir).select("src", "dst", F.element_at(F.array(F.lit("guess"), F.lit("import"), F.lit("call")), F.col("tier") + 1).alias("kind"))
    chosen = read_table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select(key("part", "p_partkey").alias("id"))
    return maps.connected(links, chosen, ["call", "import"])


def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name with its words, and the path with blanks."""
    rows = p._parts(spark, sf_dir)
    name = F.regexp_replace(F.initcap("symbol"), " ", "")
    return rows.select("id", F.concat_ws(" ", name, search.identifier_words(name)).alias("name_text"), F.translate("path", "/", " ").alias("path_text"))


def goal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read_table(spark, sf_dir, "conversations").where("role = 'user'")
    return talk.select("conv_id", "turn", F.array_join(search.goal_words(F.col("text")), " ").alias("words"))


def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by name (weight 5) and path (1): exact names first."""
    rows = p._parts(spark, sf_dir).select("id", F.col("symbol").alias("name"), F.translate("path", "/#", "  ").alias("path"))
    found = search.bm25_fields(rows, "id", {"name": 5.0, "path": 1.0}, ["red", "econ"])
    return found.join(rows.select("id", (F.lower("name") == "red gear").alias("exact")), "id").orderBy(F.desc("exact"), F.desc("score"), "id").limit(40)


def search_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference means if that is two nodes at most, else the three first by text."""
    nodes = p._geo(spark, sf_dir)
    rows = []
    for ref in REFS:
        exact = linking.resolve(spark.createDataFrame([(ref,)], "ref string"), nodes).select("ref", "id").limit(3)
        n = exact.count()
        found = exact if 0 < n <= 2 else search.prefix_match(nodes, "id", F.col("name"), ref).select(F.lit(ref).alias("ref"), "id").orderBy("id").limit(3)
        rows.append(found)
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def sparql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions as JSON, at most ten, and whether there were more."""
    t = triples.state(calls(spark, sf_dir, dst=g.ROOT), contains(spark, sf_dir))
    return triples.json_rows(triples.pattern(t, "?x", "calls", g.ROOT), 10)


def memory_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r._notes(spark, sf_dir)
    layered = maps.layered(rows, policy.matches(F.col("target"), ("src1",)), {"ones": policy.matches(F.col("target"), ("src1*",)), "fives": policy.matches(F.col("target"), ("src*5", "src0"))})
    return layered.groupBy("target", "scope", "scope_name").agg(F.count(F.lit(1)).alias("notes"))


def recall_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as a seat sees them that must not read some sources."""
    notes = r._notes(spark, sf_dir)
    hidden = notes.where(policy.matches(F.col("target"), ("src1?",))).select("target").distinct()
    target = notes.where("target = 'src1'").select("target").distinct().withColumn("rank", F.lit(0))
    return memory.recall(notes.join(hidden, "target", "left_anti"), target, ["tion"])


def running_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who signed up and have neither bought nor met an error since."""
    e = read_table(spark, sf_dir, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("started"))
    ended = e.where("event_type in ('purchase', 'error')").groupBy("user_id").agg(F.max("event_id").alias("ended"))
    return last.join(ended, "user_id", "left").where("ended is null or ended < started").select("user_id", "started")


def edit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before an edit of a supplier: hits by depth, parts among them that are tests, and what changes with it."""
    edges = calls(spark, sf_dir)
    hits = cut(traversal.impact(edges, traversal.one_seed(edges, g.ROOT), True, 6))
    tests = read_table(spark, sf_dir, "part").where("p_type = 'SMALL'").select(key("part", "p_partkey").alias("id"))
    rows = hits.groupBy(F.concat(F.lit("depth "), F.col("depth").cast("string")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.union(hits.join(tests, "id", "left_semi").agg(F.lit("tests"), F.count(F.lit(1))))
    together = g.co_change(spark, sf_dir).orderBy(F.desc("n"), "path").limit(6)
    return rows.union(together.select(F.concat(F.lit("with "), "path"), "n"))


def package_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest a folder: of the urls of a host and language the one with a query first, then by number."""
    rows = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^.*?://([^?#]*)", 1).alias("path"), F.when(F.col("url").contains("?"), 0).otherwise(1).alias("rank"))
    return maps.best_manifests(rows.select(paths.folder_of(F.col("path")).alias("folder"), F.col("path").alias("name"), "rank"))


def architecture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling, modules in loops, modules and dependencies as one table."""
    m = cut(g._strong(spark, sf_dir))
    coupling = levels.coupling_index(m).select(F.lit("coupling").alias("what"), F.col("coupling").alias("value"))
    loops = levels.strong_components(m).agg(F.lit("in loops"), F.count(F.lit(1)).cast("double"))
    size = m.agg(F.lit("dependencies"), F.count(F.lit(1)).cast("double"))
    modules = m.select("src").union(m.select("dst")).distinct().agg(F.lit("modules"), F.count(F.lit(1)).cast("double"))
    return coupling.union(loops).union(size).union(modules)


_FILES = "files AS (SELECT regexp_extract(url, '^.*?://([^?#]*)', 1) AS path, max(octet_length(encode(coalesce(html, ''))))::BIGINT AS lines FROM pages GROUP BY 1)"
_FOLDERS = _FILES + ", up AS (SELECT path, lines, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS folder, k FROM files, unnest(range(1, len(string_split(path, '/')))) AS t(k))"
_SYMBOLS = "s AS (SELECT event_id AS id, 'user/' || user_id AS path, event_type AS name, event_id AS line, user_id, ts, value FROM events)"
_PARTS = """parts AS (SELECT 'part:' || p_partkey AS id, 'part/' || p_type || '/' || p_brand AS path, p_name AS symbol, p_type, p_size, p_brand,
greatest(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END, CASE WHEN p_name IN ('blue bolt', 'no such part') THEN 2 ELSE 0 END, CASE WHEN p_brand = 'Brand#1' THEN 2 ELSE 0 END, CASE WHEN regexp_full_match(p_brand, 'Brand#1.') THEN 3 ELSE 0 END)::INT AS level FROM part)"""
_GEO = p._GEO
_TAILS = p._TAILS
_FOUND = f"""{_GEO}, {_TAILS}, q AS (SELECT unnest({list(REFS)}) AS ref),
k AS (SELECT id, 1 AS rung, id AS ref FROM g UNION SELECT id, 2, tail || ':' || name FROM t UNION SELECT id, 3, tail || ':' || owner || '.' || name FROM t UNION SELECT id, 4, name FROM g UNION SELECT id, 5, owner || '.' || name FROM g UNION SELECT id, 6, tail FROM t),
f AS (SELECT ref, rung, id, min(rung) OVER (PARTITION BY ref) AS best FROM q JOIN k USING (ref)), b AS (SELECT DISTINCT ref, id FROM f WHERE rung = best)"""
_HITS = g._UP + ", hits AS (SELECT id, depth, tier FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"

ORACLES = {
    "nodes_where": "SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE p_size > 40 AND p_type <> 'SMALL'",
    "node_lookup": "SELECT 'customer:' || c_custkey AS id, c_name AS name, c_mktsegment AS kind FROM customer WHERE c_custkey = 77",
    "graph_stats": f"""WITH {CALLS_SQL}, i AS (SELECT src AS id FROM calls UNION SELECT dst FROM calls UNION SELECT 'region:' || n_regionkey FROM nation UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'nation:' || c_nationkey FROM customer
UNION SELECT 'customer:' || c_custkey FROM customer UNION SELECT 'nation:' || s_nationkey FROM supplier UNION SELECT 'supplier:' || s_suppkey FROM supplier UNION SELECT 'customer:' || o_custkey FROM orders UNION SELECT 'order:' || o_orderkey FROM orders)
SELECT count(*) AS nodes, count(*) FILTER (id LIKE 'order:%') AS files, (SELECT count(*) FROM calls) AS edges FROM i""",
    "communities_by_size": "SELECT p_brand AS community, count(*) AS size, min('part:' || p_partkey) AS first FROM part GROUP BY 1 ORDER BY size DESC, community LIMIT 10",
    "community_members": f"""WITH {g._STRONG}, arcs AS (SELECT src, dst, sum(n)::DOUBLE AS w FROM (SELECT src, dst, n FROM s UNION ALL SELECT dst, src, n FROM s) GROUP BY 1, 2), p0 AS (SELECT DISTINCT src AS id, src AS label FROM arcs),
v AS (SELECT a.src AS id, label, w FROM arcs a JOIN p0 ON a.dst = p0.id UNION ALL SELECT id, label, 0.05 FROM p0), u AS (SELECT id, label, round(sum(w), 6) AS w FROM v GROUP BY 1, 2),
b AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM u) WHERE r = 1) SELECT label, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM b) WHERE r <= 3""",
    "resolve_one": f"""WITH {_FOUND}, n AS (SELECT ref, count(*) AS n, min(id) AS first, array_to_string(list_slice(list(id ORDER BY id), 1, 5), ' ') AS candidates FROM b GROUP BY 1)
SELECT q.ref, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'one' ELSE 'several' END AS status, CASE WHEN n = 1 THEN first ELSE '-' END AS id, CASE WHEN n > 1 THEN candidates ELSE '' END AS candidates FROM q LEFT JOIN n USING (ref)""",
    "test_paths": """WITH x AS (SELECT page_id, regexp_extract(url, '^.*?://([^?#]*)', 1) AS p FROM pages), y AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Tests/' || p WHEN 1 THEN p || '.spec.ts' WHEN 2 THEN 'src/test_' || page_id
WHEN 3 THEN 'latest/' || p WHEN 4 THEN p || '_test.go' ELSE 'test_' || p END AS path FROM x), z AS (SELECT *, lower(path) AS l FROM y)
SELECT page_id, path, l LIKE 'test/%' OR l LIKE 'tests/%' OR contains(l, '/test/') OR contains(l, '/tests/') OR contains(l, '__tests__') OR contains(l, '.test.') OR contains(l, '.spec.') OR contains(l, '_test.')
OR starts_with(string_split(l, '/')[-1], 'test_') OR starts_with(l, 'e2e/') OR contains(l, '/e2e/') AS test FROM z""",
    "handler_names": """WITH n AS (SELECT CASE event_id % 4 WHEN 0 THEN 'handle_' || event_type WHEN 1 THEN event_type || 'Handler' WHEN 2 THEN event_type || '_handler' ELSE event_type || 'handler' END AS name FROM events)
SELECT name, count(*) AS n, starts_with(name, 'handle') OR ends_with(name, 'Handler') OR ends_with(name, '_handler') AS handler FROM n GROUP BY 1""",
    "public_names": r"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'tion') AND regexp_matches(line, '^\s*(The |La |Die )')",
    "file_box": f"""WITH {_FILES}, l AS (SELECT path, lower(path) AS l FROM files) SELECT path FROM l WHERE regexp_full_match(l, '[^/]*\\.example\\.com/en/[^/]*') OR regexp_full_match(string_split(l, '/')[-1], '[^/]*\\.example\\.com/en/[^/]*')
OR contains(l, '/de/') OR starts_with(l, 'de/') OR contains(l, '/77') OR regexp_full_match(l, '.*org/fr/1[^/]*') OR regexp_full_match(string_split(l, '/')[-1], '.*org/fr/1[^/]*')""",
    "common_folders": """WITH x AS (SELECT regexp_extract(url, '^(.*?)://', 1) AS scheme, regexp_extract(url, '^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '^.*?://([^?#]*)', 1) AS path FROM pages),
y AS (SELECT host AS k, path FROM x UNION ALL SELECT scheme, path FROM x), z AS (SELECT k, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS folder, i, path FROM y, unnest(range(1, len(string_split(path, '/')))) AS t(i)),
n AS (SELECT k, count(DISTINCT path) AS n FROM y GROUP BY 1), f AS (SELECT k, folder, i FROM z JOIN n USING (k) GROUP BY k, folder, i, n HAVING count(DISTINCT path) = n)
SELECT k AS "of", coalesce((SELECT arg_max(folder, i) FROM f WHERE f.k = n.k), 'root') AS folder FROM n""",
    "unreadable_paths": f"WITH {_PARTS} SELECT DISTINCT path FROM parts WHERE level = 3",
    "research_files": f"WITH {_PARTS} SELECT path, max(level)::INT AS level, count(*) AS symbols FROM parts GROUP BY 1 HAVING max(level) <= 1",
    "first_owners": f"""WITH {_SYMBOLS}, c AS (SELECT path, name, arg_min(id, line)::VARCHAR AS id FROM s GROUP BY 1, 2), m AS (SELECT id, path, CASE name WHEN 'view' THEN 'click' WHEN 'purchase' THEN 'signup' ELSE 'none' END AS parent_name FROM s)
SELECT coalesce(c.id, m.path) AS owner, count(*) AS members FROM m LEFT JOIN c ON m.path = c.path AND parent_name = c.name GROUP BY 1""",
    "self_targets": f"""WITH {_SYMBOLS}, o AS (SELECT path, ts::DATE AS d, min(id) AS id FROM s WHERE name = 'error' GROUP BY 1, 2 HAVING count(*) = 1) SELECT s.id AS site, o.id FROM s JOIN o ON s.path = o.path AND s.ts::DATE = o.d WHERE s.name = 'click'""",
    "route_handlers": """WITH d AS (SELECT 'part:' || p_partkey AS id, p_brand AS path, p_name || ' ' || p_size AS name, p_partkey AS line FROM part), r AS (SELECT 'customer:' || c_custkey AS route, 'Brand#' || (c_nationkey + 1) AS path, p_name || ' ' || p_size AS name FROM customer JOIN part ON c_custkey = p_partkey),
h AS (SELECT path, name, arg_min(id, line) AS own FROM d GROUP BY 1, 2), o AS (SELECT name, min(id) AS far FROM d GROUP BY 1 HAVING count(*) = 1)
SELECT route, coalesce(own, far) AS id, (CASE WHEN own IS NOT NULL THEN 2 ELSE 1 END)::INT AS tier FROM r LEFT JOIN h USING (path, name) LEFT JOIN o USING (name) WHERE coalesce(own, far) IS NOT NULL""",
    "env_readers": "SELECT DISTINCT 'user:' || user_id AS reader, json_extract_string(props, '$.k') AS key, ts::DATE::VARCHAR AS line FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "file_of_node": "SELECT 'region:' || n_regionkey AS top, 3::INT AS levels, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "nodes_near": f"""WITH {_SYMBOLS} SELECT 'file' AS what, 'user/7' AS id FROM events WHERE user_id = 7 GROUP BY 1 UNION ALL (SELECT 'symbol', name || '#' || id FROM s WHERE path = 'user/7' ORDER BY line LIMIT 40)
UNION ALL (SELECT 'sibling', path FROM (SELECT DISTINCT path FROM s WHERE path <> 'user/7') ORDER BY path LIMIT 12)""",
    "hand_offs": """WITH f AS (SELECT p_brand AS slice, c_mktsegment AS seat, min(o_orderdate) AS since FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
d AS (SELECT slice, seat AS "from" FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY since, seat) AS r FROM f) WHERE r = 1) SELECT "from", seat AS "to", count(*) AS slices FROM f JOIN d USING (slice) WHERE seat <> "from" GROUP BY 1, 2""",
    "loc_rollup": """WITH l AS (SELECT l_orderkey, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT 'nation:' || c_nationkey AS owner, count(*) AS symbols, sum(greatest(date_diff('day', o_orderdate, b) + 1, 0))::BIGINT AS lines
FROM orders JOIN l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "churn_by_folder": f"WITH {_FOLDERS} SELECT folder, count(DISTINCT path) AS files FROM up GROUP BY 1",
    "module_tree": f"""WITH {_FOLDERS} SELECT folder AS module, k::INT AS level, array_to_string(list_slice(string_split(folder, '/'), 1, k - 1), '/') AS parent, count(*) AS files, sum(lines)::BIGINT AS lines FROM up GROUP BY folder, k""",
    "module_tree_zoom": f"WITH {_FOLDERS} SELECT folder AS module, count(*) AS files FROM up WHERE k = 1 GROUP BY 1 HAVING sum(lines) > 0",
    "refusals_per_slice": "SELECT json_extract_string(props, '$.k') AS slice, count(*) AS refusals FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1",
    "languages_present": "SELECT lang, count(*) AS files, coalesce(lang IN ('en', 'fr'), false) AS installed FROM documents GROUP BY 1",
    "stable_keys": "SELECT l_orderkey || ':' || l_linenumber || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS stable, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS r FROM lineitem)",
    "entity_iris": "SELECT p_partkey AS line, 'urn:sym:' || replace(p_type, ' ', '%20') || '#' || replace(p_name, ' ', '%20') || CASE WHEN r > 1 THEN '~' || p_partkey ELSE '' END AS iri FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS r FROM part)",
    "unique_labels": "SELECT c_custkey AS id, c_mktsegment || '/' || c_nationkey || CASE WHEN r > 1 THEN ' ' || r ELSE '' END AS unique_label FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)",
    "class_terms": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Function' WHEN 1 THEN 'File' WHEN 2 THEN 'Route' WHEN 3 THEN 'Env' ELSE 'Symbol' END AS class, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "brief_entries": f"""WITH {_SYMBOLS}, x AS (SELECT name AS kind, id::VARCHAR AS name, path AS file, row_number() OVER (PARTITION BY name ORDER BY path, id::VARCHAR) AS r FROM s)
SELECT kind, name, file FROM x WHERE kind NOT IN ('click', 'view') OR (kind = 'click' AND r <= 5) OR (kind = 'view' AND r <= 10)""",
    "experiment_gaps": """WITH t AS (SELECT event_id, user_id, value, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_type = 'purchase')
SELECT event_id, coalesce(greatest(sec - max(sec) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap FROM t""",
    "impact_first": f"WITH {_HITS} SELECT id, depth, tier FROM hits ORDER BY depth, id LIMIT 50",
    "flows_first": g.ORACLES["flows_reach"] + " ORDER BY reach DESC, entry LIMIT 20",
    "boundary_first": g.ORACLES["isolate_boundary"] + " ORDER BY n DESC, outside, direction LIMIT 20",
    "module_pick": f"WITH {FLOWS_SQL}, m AS (SELECT src, dst, count(*) AS n FROM flows WHERE src <> dst GROUP BY 1, 2) SELECT dst, sum(n)::BIGINT AS churn, count(*) AS fan_in FROM m GROUP BY 1 ORDER BY churn DESC, fan_in DESC, dst LIMIT 1",
    "changed_visible": f"WITH {_PARTS} SELECT DISTINCT path FROM parts WHERE (p_size > 45 OR p_size < 3) AND level < 3",
    "triples_visible": f"""WITH h AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2), e AS (SELECT DISTINCT 'order:3' AS s, 'part:' || l_partkey AS o FROM lineitem WHERE l_orderkey = 3),
c AS (SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS o FROM nation UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
t AS (SELECT s, 'calls' AS p, o FROM e UNION ALL SELECT s, 'contains', o FROM c UNION ALL SELECT id, 'a', string_split(id, ':')[1] FROM (SELECT s AS id FROM e UNION SELECT o FROM e UNION SELECT s FROM c UNION SELECT o FROM c))
SELECT p, count(*) AS n FROM t WHERE s NOT IN (SELECT id FROM h) AND o NOT IN (SELECT id FROM h) GROUP BY 1""",
    "selector_union": "SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand = 'Brand#3' OR p_size = 7 OR p_name LIKE 'blue%'",
    "entry_points": f"""WITH {_PARTS} SELECT 'cli' AS kind, symbol AS name, path AS file FROM parts WHERE symbol LIKE '%bolt' UNION SELECT 'http', symbol, path FROM parts WHERE starts_with(symbol, 'handle') OR ends_with(symbol, 'Handler') OR ends_with(symbol, '_handler') OR p_size = 1
UNION SELECT 'test', symbol, path FROM parts WHERE p_type = 'SMALL' AND p_size > 45""",
    "hot_symbols": """WITH f AS (SELECT p_brand AS module, 'part:' || p_partkey AS name, count(DISTINCT l_orderkey) AS fan_in FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), c AS (SELECT p_brand AS module, count(*) AS churn FROM part WHERE p_size > 25 GROUP BY 1)
SELECT module, name, score FROM (SELECT module, name, fan_in * churn AS score, row_number() OVER (PARTITION BY module ORDER BY fan_in * churn DESC, name) AS r FROM f JOIN c USING (module)) WHERE r <= 5""",
    "module_report": f"""WITH {g._STRONG}, o AS (SELECT src AS id, count(DISTINCT dst) AS n FROM s GROUP BY 1), i AS (SELECT dst AS id, count(DISTINCT src) AS n FROM s GROUP BY 1)
SELECT coalesce(o.id, i.id) AS module, coalesce(o.n, 0) AS depends_on, coalesce(i.n, 0) AS used_by FROM o FULL JOIN i ON o.id = i.id""",
    "closes_loop": f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'order:3' AS id UNION SELECT dst FROM calls JOIN r ON src = id) SELECT target, target IN (SELECT id FROM r) AS closes FROM (SELECT unnest(['supplier:7', 'region:1']) AS target)""",
    "connected_files": f"""WITH {CALLS_SQL}, c AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand = 'Brand#3'), e AS (SELECT * FROM calls WHERE tier > 0)
SELECT id FROM (SELECT dst AS id FROM e WHERE src IN (SELECT id FROM c) UNION SELECT src FROM e WHERE dst IN (SELECT id FROM c)) WHERE id NOT IN (SELECT id FROM c)""",
    "index_text": f"""WITH {_PARTS}, n AS (SELECT id, path, symbol, array_to_string(list_transform(string_split(symbol, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS name FROM parts) SELECT id, name || ' ' || lower(symbol) AS name_text, replace(path, '/', ' ') AS path_text FROM n""",
    "goal_words": r"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda x: lower(x)),
lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with', 'into', 'from', 'that', 'this', 'add', 'fix', 'make', 'use', 'all')) AS l FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM w""",
    "search_fields": f"""WITH {_PARTS}, d AS (SELECT id, symbol AS name, string_split(lower(symbol), ' ') AS a, list_filter(string_split(replace(replace(lower(path), '/', ' '), '#', ' '), ' '), lambda x: x <> '') AS b FROM parts),
t AS (SELECT *, [len(list_filter(a, lambda x: starts_with(x, 'red'))), len(list_filter(a, lambda x: starts_with(x, 'econ')))] AS ta, [len(list_filter(b, lambda x: starts_with(x, 'red'))), len(list_filter(b, lambda x: starts_with(x, 'econ')))] AS tb FROM d),
n AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS l, count(*) FILTER (ta[1] + tb[1] > 0) AS d1, count(*) FILTER (ta[2] + tb[2] > 0) AS d2 FROM t),
w AS (SELECT id, name, len(a) + len(b) AS len, 5.0::DOUBLE * ta[1] + tb[1] AS f1, 5.0::DOUBLE * ta[2] + tb[2] AS f2 FROM t)
SELECT id, lower(name) = 'red gear' AS exact, round(ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / l))
+ ln(1 + (n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)) * f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / l)), 6) AS score FROM w, n WHERE f1 > 0 AND f2 > 0 ORDER BY exact DESC, score DESC, id LIMIT 40""",
    "search_seeds": f"""WITH {_FOUND}, n AS (SELECT ref, count(*) AS n FROM b GROUP BY 1), w AS (SELECT id, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM g),
z AS (SELECT q.ref, list_filter(regexp_split_to_array(lower(q.ref), '[^\\w]+'), lambda x: x <> '') AS t FROM q LEFT JOIN n USING (ref) WHERE coalesce(n, 0) NOT IN (1, 2)),
m AS (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY id) AS r FROM z, w WHERE len(list_filter(t, lambda x: len(list_filter(w, lambda y: starts_with(y, x))) > 0)) = len(t))
SELECT b.ref, b.id FROM b JOIN n USING (ref) WHERE n <= 2 UNION ALL SELECT ref, id FROM m WHERE r <= 3""",
    "sparql_rows": f"""WITH {CALLS_SQL}, x AS (SELECT src FROM calls WHERE dst = '{g.ROOT}') SELECT '{{"x":"' || src || '"}}' AS "row", (SELECT count(*) > 10 FROM x) AS truncated FROM (SELECT src FROM x ORDER BY '{{"x":"' || src || '"}}' LIMIT 10)""",
    "memory_layers": """SELECT source AS target, CASE WHEN source = 'src1' THEN 'task' WHEN source LIKE 'src1%' OR source LIKE 'src%5' OR source = 'src0' THEN 'workflow' ELSE 'repo' END AS scope,
CASE WHEN source = 'src1' THEN '' WHEN source LIKE 'src1%' THEN 'ones' WHEN source LIKE 'src%5' OR source = 'src0' THEN 'fives' ELSE '' END AS scope_name, count(*) AS notes FROM documents GROUP BY 1, 2, 3""",
    "recall_visible": """WITH x AS (SELECT doc_id AS id, source AS target, (CASE WHEN source = 'src1' THEN 0 ELSE 4 END)::INT AS rank, (CASE WHEN contains(lower(source || ' ' || coalesce(text, '')), 'tion') THEN 1 ELSE 0 END)::INT AS hits FROM documents WHERE NOT regexp_full_match(source, 'src1.'))
SELECT * FROM x WHERE rank < 4 OR hits > 0""",
    "running_runs": """WITH l AS (SELECT user_id, max(event_id) AS started FROM events WHERE event_type = 'signup' GROUP BY 1), e AS (SELECT user_id, max(event_id) AS ended FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT user_id, started FROM l LEFT JOIN e USING (user_id) WHERE ended IS NULL OR ended < started""",
    "edit_report": f"""WITH {_HITS}, {g._COMMITS}, w AS (SELECT DISTINCT sha, ts FROM commits WHERE path = '{g.ROOT}' ORDER BY ts DESC, sha DESC LIMIT 150), f AS (SELECT DISTINCT sha, path FROM commits WHERE sha IN (SELECT sha FROM w)),
k AS (SELECT sha FROM f GROUP BY 1 HAVING count(*) <= 40), c AS (SELECT path, count(*) AS n FROM f WHERE sha IN (SELECT sha FROM k) AND path <> '{g.ROOT}' GROUP BY 1 HAVING count(*) >= 2)
SELECT 'depth ' || depth AS what, count(*) AS n FROM hits GROUP BY 1 UNION ALL SELECT 'tests', count(*) FROM hits WHERE id IN (SELECT 'part:' || p_partkey FROM part WHERE p_type = 'SMALL') UNION ALL (SELECT 'with ' || path, n FROM c ORDER BY n DESC, path LIMIT 6)""",
    "package_folders": """WITH x AS (SELECT regexp_extract(url, '^.*?://([^?#]*)', 1) AS path, CASE WHEN contains(url, '?') THEN 0 ELSE 1 END AS rank FROM pages),
y AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path AS name, rank FROM x) SELECT folder, name FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY rank, name) AS r FROM y) WHERE r = 1""",
    "architecture_report": f"""WITH RECURSIVE {g._STRONG}, d AS (SELECT dst, count(DISTINCT src) AS d FROM s GROUP BY 1), r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src)
SELECT 'coupling' AS what, (SELECT round(sum(d)::DOUBLE / (count(*) * max(d)), 6) FROM d) AS value UNION ALL SELECT 'in loops', (SELECT count(DISTINCT src)::DOUBLE FROM r WHERE src = dst)
UNION ALL SELECT 'dependencies', (SELECT count(*)::DOUBLE FROM s) UNION ALL SELECT 'modules', (SELECT count(*)::DOUBLE FROM (SELECT src FROM s UNION SELECT dst FROM s))""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
