"""Merkle manifest of a dataset with a witness for every row (operator 12).

Rows are dealt in aligned blocks of ``2 ** LEVELS`` leaves. Within a block leaves are appended one by one: a leaf joins the open
subtrees with an empty witness, and each time a subtree's sibling is complete, the witnesses of both are extended by the
other's root. A block's root is then one more node that is appended to the blocks above, in the same way, up to the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import broadcast_if_small, filed

#: levels of a block's subtree
LEVELS = 11
#: steps of a witness: the letter tells where the sibling stands, or that a run's last node is alone
LEFT, RIGHT, ALONE = "l", "r", "o"


class Forest:
    """The open subtrees of a growing tree, highest first, and for each leaf its witness as far as siblings are complete."""

    def __init__(self) -> None:
        self.witnesses: list[list[str]] = []
        self.open: list[tuple[int, str, int]] = []  # height, root, first leaf

    def append(self, node: str) -> None:
        self.open.append((0, node, len(self.witnesses)))
        self.witnesses.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def close(self, height: int = 0) -> str:
        """The root, once no leaf follows; at least ``height`` levels above the leaves."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
            else:
                self._raise()
        return self.open[0][1]

    def _join(self) -> None:
        (height, right, middle), (_, left, first) = self.open.pop(), self.open.pop()
        for w in self.witnesses[first:middle]:
            w.append(RIGHT + right)
        for w in self.witnesses[middle:]:
            w.append(LEFT + left)
        self.open.append((height + 1, hashlib.sha256((left + right).encode()).hexdigest(), first))

    def _raise(self) -> None:
        height, node, first = self.open.pop()
        for w in self.witnesses[first:]:
            w.append(ALONE)
        self.open.append((height + 1, hashlib.sha256(node.encode()).hexdigest(), first))


def _grown(rows: pa.Table, levels: int) -> pa.Table:
    """The rows of one block with their witnesses within it and its root."""
    rows, forest = rows.take(pc.sort_indices(rows["idx"])), Forest()
    for node in rows["node"].to_pylist():
        forest.append(node)
    top = forest.close(levels if rows["n"][0].as_py() > 1 << levels else 0)
    return rows.append_column("steps", pa.array(forest.witnesses, pa.list_(pa.string()))).append_column("top", pa.array([top] * len(rows), pa.string()))


def witnesses(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` and ``steps, root``; nodes have ``tree``, ``idx`` (from 0, gapless), ``n`` (nodes of the tree) and ``node``, none null.

    One task sees the rows of a block; trees of any size are cut into blocks, and their roots are a table of ``2 ** -levels`` of the rows.
    """
    size = 1 << levels
    rows = nodes.withColumn("block", F.expr(f"idx div {size}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    grown = filed(rows.groupBy("tree", "block").applyInArrow(lambda t: _grown(t, levels), f"{schema}, steps array<string>, top string"), "merkle-blocks")
    if not grown.where(F.col("n") > size).limit(1).count():
        return grown.withColumnRenamed("top", "root").drop("block")
    tops = grown.where(f"n > {size} and idx % {size} = 0").select("tree", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("node"))
    above = witnesses(tops, levels).select("tree", F.col("idx").alias("block"), F.col("steps").alias("more"), "root")
    # few rows: one a block
    both = grown.join(broadcast_if_small(above), ["tree", "block"], "left")
    steps = F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more"))
    return both.withColumn("steps", steps).withColumn("root", F.coalesce("root", "top")).drop("more", "top", "block")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` and ``idx, n``: the place within its ``tree``, from 0, and the tree's rows; rows that tie are dealt evenly too.

    Ranges of rows are sorted apart, and their counts, one row a tree and range, added up: no tree is gathered in a task.
    """
    keys = ["tree", *order, "at"]
    rows = filed(rows.withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    ranges = filed(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranges.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    inside = Window.partitionBy("tree", "part").orderBy(*order, "at")
    placed = ranges.withColumn("idx", F.row_number().over(inside) - 1).join(broadcast_if_small(counts), ["tree", "part"])
    return placed.withColumn("idx", (F.col("idx") + F.col("base")).cast("long")).drop("part", "base", "at")


def field(value: Column) -> Column:
    """A value as text that no neighbour can change: its length in bytes and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text"))), 256)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, altered, subroot, root, steps`` for every row of ``docs``.

    A language is a tree whose leaves ascend by doc_id (rows that repeat an id: by leaf; null first), and the languages' roots, in the order of their bytes with
    null first, are the leaves of the last tree. ``steps`` is the witness up to ``root``: ``l`` or ``r`` and the sibling on
    that side, ``o`` where a node is alone. ``altered`` is the leaf after tampering, null where nothing is tampered with.
    Texts are read once and only digests go on. Nulls are values of their own; equal rows get a place each; an empty table gives no rows; other columns don't matter.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0  # null for no doc_id, which is left alone
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    # an empty key for null comes first, and the mark keeps the order of bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = docs.select("doc_id", tree.alias("tree"), leaf(F.col("n_chars")).alias("node"), F.when(tampered, leaf(more)).alias("altered"))
    grown = filed(witnesses(numbered(rows, ["doc_id", "node"]), levels), "merkle-trees")
    trees = grown.where("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    above = witnesses(numbered(trees, ["name"]), levels).select(F.col("name").alias("tree"), F.col("root").alias("whole"), F.col("steps").alias("more"))
    both = grown.join(broadcast_if_small(above), "tree")
    return both.select("doc_id", F.col("node").alias("leaf"), "altered", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("steps", "more").alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    side = lambda s: F.substr(s, F.lit(1), F.lit(1))
    other = lambda s: F.substr(s, F.lit(2))
    step = lambda node, s: F.sha2(F.when(side(s) == LEFT, F.concat(other(s), node)).when(side(s) == RIGHT, F.concat(node, other(s))).otherwise(node), 256)
    return F.aggregate(steps, leaf, step)


def verify(rows: DataFrame) -> DataFrame:
    """The rows of :func:`manifest` held against their root, after tampering: with ``proof_sha256``, ``folded_root`` and ``verified``."""
    siblings = F.transform(F.filter("steps", lambda s: s != ALONE), lambda s: F.substr(s, F.lit(2)))
    rows = rows.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    proof = F.sha2(F.array_join(siblings, ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# Levels are built one by one from below; a node keeps the first and last place of the leaves under it, so that a leaf finds its siblings by place.
ORACLE = """
WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER () AS r,
    -- CRC-32 of the digits, bit by bit: a byte is mixed in, then eight shifts follow
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
  FROM documents),
parts AS (SELECT r, doc_id, lang, crc, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body FROM docs),
leaves AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || body) AS altered FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM leaves),
low AS (
  SELECT 0 AS lev, lang, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT max(lev) + 1, lang, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, idx // 2),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY CAST(lang AS BLOB) NULLS FIRST) - 1 AS idx FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lev, idx, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT max(lev) + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY idx // 2),
tree AS (SELECT lev, 0 AS up, lang, idx, h FROM low WHERE n > 1 UNION ALL SELECT lev, 1, NULL, idx, h FROM high WHERE n > 1),
walk AS (
  SELECT p.r, t.up, t.lev, CASE WHEN t.up = 0 THEN p.idx ELSE s.idx END // CAST(power(2, t.lev) AS BIGINT) AS place, o.h AS other
  FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN (SELECT DISTINCT up, lev, lang FROM tree) t ON t.up = 1 OR t.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN tree o ON o.up = t.up AND o.lev = t.lev AND o.lang IS NOT DISTINCT FROM t.lang
    AND o.idx = xor(CASE WHEN t.up = 0 THEN p.idx ELSE s.idx END // CAST(power(2, t.lev) AS BIGINT), 1)),
steps AS (SELECT r, list({'place': place, 'other': other} ORDER BY up, lev) AS steps FROM walk GROUP BY r),
done AS (SELECT p.*, s.subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(w.steps, []) AS steps FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN steps w USING (r)),
folds AS (
  SELECT r, altered AS h, 0 AS k, steps FROM done
  UNION ALL
  SELECT r, sha256(CASE WHEN steps[k + 1].other IS NULL THEN h WHEN steps[k + 1].place % 2 = 1 THEN steps[k + 1].other || h ELSE h || steps[k + 1].other END), k + 1, steps
  FROM folds WHERE k < len(steps))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(d.steps, lambda s: s.other IS NOT NULL), lambda s: s.other), ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = root AS verified
FROM done d JOIN folds f ON f.r = d.r AND f.k = len(d.steps)
"""
