"""The relational tables seen as a property graph: nodes, typed edges, commits, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import dealt, parts_of, read_table

#: confidence of an edge: guessed < inferred < resolved
TIERS = ("guessed", "inferred", "resolved")


def key(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def _tier() -> Column:
    return F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)


def _calls(lines: DataFrame, a: tuple[str, str], b: tuple[str, str], parts: int | None = None) -> DataFrame:
    """One edge a pair; pairs are counted as numbers and named last. Nearly every line is a pair of its own, so lines are dealt out by pair before they are counted."""
    pairs = dealt(lines, parts, a[1], b[1]).groupBy(a[1], b[1]).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("l_linenumber").cast("long").alias("line"), F.max(_tier()).cast("int").alias("tier"))
    return pairs.select(key(*a).alias("src"), key(*b).alias("dst"), "weight", "line", "tier")


def _touching(lines: DataFrame, end: tuple[str, str], node: str | None) -> DataFrame | None:
    """The lines of one node, told to the scan as a number; None if it is of another kind."""
    if node is None:
        return lines
    kind, _, number = node.partition(":")
    return lines.where(F.col(end[1]) == int(number)) if kind == end[0] and number.isdigit() else None


def calls(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, src: str | None = None, dst: str | None = None) -> DataFrame:
    """``src, dst, weight, line, tier``: order to part and part to supplier, one edge a pair.

    With ``src`` or ``dst`` only the edges of that node, without a look at other lines.
    """
    whole = read_table(spark, sf_dir, "lineitem")
    parts = parts_of(whole) if src is None and dst is None else None
    lines = whole if lines is None else lines
    order, part, supplier = ("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")
    found = []
    for a, b in ((order, part), (part, supplier)):
        own = _touching(lines, a, src)
        own = own if own is None else _touching(own, b, dst)
        if own is not None:
            found.append(_calls(own, a, b, parts))
    if not found:
        return _calls(lines.where("false"), order, part)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


#: kinds of the nodes that calls are between, by their number
CALLED = ("order", "part", "supplier")
#: kinds that have numbers: those and what contains orders
NUMBERED = (*CALLED, "customer")


def number(column: str, kind: str) -> Column:
    return F.col(column).cast("long") * 4 + NUMBERED.index(kind)


def tiered_calls(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """``src, dst, tier`` of the calls as numbers, dealt into so many parts by ``src``."""
    lines = read_table(spark, sf_dir, "lineitem")
    ends = [lines.select(number(a, k).alias("src"), number(b, m).alias("dst"), _tier().alias("tier")) for a, k, b, m in (("l_orderkey", "order", "l_partkey", "part"), ("l_partkey", "part", "l_suppkey", "supplier"))]
    return dealt(ends[0].union(ends[1]), parts, "src").groupBy("src", "dst").agg(F.max("tier").cast("int").alias("tier"))


def numbered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst`` of the calls as numbers, four times the key and the kind: 8 bytes a node. ``named`` tells the node."""
    lines = read_table(spark, sf_dir, "lineitem")
    no = lambda column, kind: (F.col(column).cast("long") * 4 + kind)
    pairs = [lines.select(no(a, k).alias("src"), no(b, k + 1).alias("dst")).repartition("src").distinct() for k, (a, b) in enumerate((("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey")))]
    return pairs[0].union(pairs[1])


def named(number: str) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in NUMBERED]), (F.pmod(number, F.lit(4)) + 1).cast("int"))
    return F.concat(kind, F.lit(":"), F.shiftright(number, 2).cast("string"))


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parent, child``: region, nation, then customers and suppliers, then orders."""
    pairs = [("nation", "region", "n_regionkey", "nation", "n_nationkey"), ("customer", "nation", "c_nationkey", "customer", "c_custkey"),
             ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"), ("orders", "customer", "o_custkey", "order", "o_orderkey")]
    parts = [read_table(spark, sf_dir, t).select(key(a, x).alias("parent"), key(b, y).alias("child")) for t, a, x, b, y in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, n, customer, supplier`` rows: one per line, from the customer's nation to the supplier's."""
    t = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(key("nation", "c_nationkey").alias("src"), key("nation", "s_nationkey").alias("dst"), "o_orderkey", "l_partkey")


CALLS_SQL = """calls AS (
SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, count(*)::DOUBLE AS weight, min(l_linenumber)::BIGINT AS line,
  max(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)::INT AS tier FROM lineitem GROUP BY 1, 2
UNION ALL
SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, count(*)::DOUBLE, min(l_linenumber)::BIGINT,
  max(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)::INT FROM lineitem GROUP BY 1, 2)"""

FLOWS_SQL = """flows AS (SELECT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst, o_orderkey, l_partkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
