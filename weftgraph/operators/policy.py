"""Which rules fence a path or a symbol, and the strictest of them.

A rule list is configuration: some hundred rules at most. It becomes one expression per row, so that no join is
needed and a decision stays inside the scan's stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.intervals import overlapping_lines
from weftgraph.operators.ranking import smallest_k

#: from free to out of sight
LEVELS = ("open", "scope", "locked", "hidden")
OPEN, SCOPE, LOCKED, HIDDEN = range(4)
#: where this engine's own configuration lies
OWN = (".weftgraph", "weftgraph.toml", "**/.weftgraph/**")


@dataclass(frozen=True)
class Rule:
    name: str
    level: int
    globs: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    reason: str = ""


def glob_regex(glob: str) -> str:
    """An anchored pattern; ``*`` crosses folders, and a glob without ``*`` also means all below it."""
    out, i, glob = "", 0, glob.removeprefix("./")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        end = glob.find("}", i) if glob[i] == "{" else -1
        if end > 0:
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
            continue
        out += {"*": ".*", "?": "."}.get(glob[i], re.escape(glob[i]))
        i += 1
    below = "" if "*" in glob else "(?:/.*)?"
    return f"^{out.rstrip('/')}{below}$"


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    """True if any glob fits; a null path fits none."""
    return F.coalesce(path.rlike("|".join(map(glob_regex, globs))), F.lit(False)) if globs else F.lit(False)


def in_scope(path: Column, scopes: list[str]) -> Column:
    """The path is a scope or lies below one; ``.`` holds all."""
    out = F.lit("." in scopes)
    for s in scopes:
        out = out | (path == s) | path.startswith(s.rstrip("/") + "/")
    return F.coalesce(out, F.lit(False))


def hits(rules: list[Rule], path: Column, symbol: Column) -> Column:
    """Array of ``level, first, rule, reason`` of all rules that fit, in their order (``first`` falls)."""
    made = [
        F.when(
            matches(path, r.globs) | F.coalesce(symbol.isin(*r.symbols), F.lit(False)) if r.symbols else matches(path, r.globs),
            F.struct(F.lit(r.level).alias("level"), F.lit(-i).alias("first"), F.lit(r.name).alias("rule"), F.lit(r.reason).alias("reason")),
        )
        for i, r in enumerate(rules)
    ]
    return F.filter(F.array(*made), lambda h: h.isNotNull())


def decide(rules: list[Rule], path: Column, symbol: Column) -> Column:
    """The strictest hit, the first rule among equals; null if none fits."""
    return F.array_max(hits(rules, path, symbol))


def verdicts(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """``nodes`` (``path, symbol``) with ``level`` and ``rule`` (null if free)."""
    d = decide(rules, F.col("path"), F.col("symbol"))
    return nodes.withColumn("_d", d).withColumn("level", F.coalesce("_d.level", F.lit(OPEN))).withColumn("rule", F.col("_d.rule")).drop("_d")


def explain(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a hit: ``path, symbol, rule, level, decides``."""
    h = nodes.select("path", "symbol", hits(rules, F.col("path"), F.col("symbol")).alias("h"))
    best = F.array_max("h")
    return h.select("path", "symbol", best.alias("b"), F.explode("h").alias("x")).select("path", "symbol", "x.rule", "x.level", (F.col("x.first") == F.col("b.first")).alias("decides"))


def file_verdicts(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """``path, level``: the strictest over a file and all symbols in it."""
    return verdicts(nodes, rules).groupBy("path").agg(F.max("level").alias("level"))


def visible(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """Without hidden rows; use it before any count."""
    return verdicts(nodes, rules).where(F.col("level") < HIDDEN).select(*nodes.columns)


def _symbols(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = [(r.name, s) for r in rules for s in r.symbols]
    return nodes.sparkSession.createDataFrame(rows, "rule string, symbol string")


def dangling(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule, symbol`` of rules on symbols that no node has."""
    return _symbols(nodes, rules).join(nodes.select("symbol").distinct(), "symbol", "left_anti").select("rule", "symbol")


def ambiguous(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule, symbol, n`` of rules on bare names that more than one definition has."""
    n = nodes.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.join(F.broadcast(_symbols(nodes, rules)), "symbol").select("rule", "symbol", "n")


def changed_fenced(base: DataFrame, head: DataFrame, rules: list[Rule]) -> DataFrame:
    """``path, symbol, level`` of fenced symbols whose bodies differ as multisets.

    Both have ``path, symbol, body``. Bodies are counted, not gathered, so one symbol may have any number.
    """
    keys = ["path", "symbol", "body"]
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("b")).join(head.groupBy(*keys).agg(F.count(F.lit(1)).alias("h")), keys, "full")
    moved = n.where(~F.col("b").eqNullSafe(F.col("h"))).select("path", "symbol").distinct()
    return verdicts(moved, rules).where(F.col("level") > OPEN).select("path", "symbol", "level")


def seat_overlap(files: DataFrame, seats: dict[str, tuple[str, ...]], shown: int = 8) -> DataFrame:
    """``a, b, n, first``: files that two seats may both edit, and the first few; pairs of seats are made per row."""
    names = sorted(seats)
    pairs = [F.when(matches(F.col("path"), seats[a]) & matches(F.col("path"), seats[b]), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = files.select("path", F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("p")).select("p.a", "p.b", "path").distinct()
    counts = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    first = smallest_k(both, ["a", "b"], ["path"], shown).groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_list("path")), " ").alias("first"))
    return counts.join(first, ["a", "b"])


def area_fence(files: DataFrame, rules: list[Rule], area: str) -> DataFrame:
    """``area, level``: the level most of an area's files have, ties to the stricter."""
    counts = verdicts(files, rules).groupBy(area, "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(area).agg(F.max(F.struct("n", "level")).alias("m")).select(area, "m.level")


def with_own(rules: list[Rule], globs: tuple[str, ...] = OWN) -> list[Rule]:
    """The rules and, before all of them, the one that locks the configuration that they come from."""
    return [Rule("own configuration", LOCKED, globs=globs, reason="rules are changed by people"), *rules]


def touched_verdicts(ranges: DataFrame, spans: DataFrame, rules: list[Rule]) -> DataFrame:
    """``change, path, symbols, level, rule`` of changes ``change, path, ra, rb``: the strictest verdict over a file and the symbols whose lines were touched.

    ``spans``: ``path, symbol, first, last``. A file that no span was touched in is judged by its path alone, with no symbols; ties go to the first rule.
    """
    met = overlapping_lines(spans, ranges, ["path"]).select("change", "path", "symbol")
    both = met.unionByName(ranges.select("change", "path", F.lit(None).cast("string").alias("symbol"))).distinct()
    judged = both.withColumn("_d", decide(rules, F.col("path"), F.col("symbol")))
    worst = judged.groupBy("change", "path").agg(F.count("symbol").alias("symbols"), F.max("_d").alias("_d"))
    return worst.select("change", "path", "symbols", F.coalesce("_d.level", F.lit(OPEN)).alias("level"), F.coalesce("_d.rule", F.lit("-")).alias("rule"))
