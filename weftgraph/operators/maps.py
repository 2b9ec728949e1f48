"""Modules of a tree of files: sizes, churn, entries, surroundings and what stands out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.paths import folder_of, folders_of
from weftgraph.operators.ranking import smallest_k
from weftgraph.session import cut


def communities(nodes: DataFrame) -> DataFrame:
    """``community, size, first`` of ``id, community``."""
    return nodes.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))


def climb(nodes: DataFrame, tree: DataFrame, goal: Column, most_levels: int = 8) -> DataFrame:
    """``id, top, levels``: the nearest node at or above each ``id`` that meets a condition on ``at``; ``tree`` has ``parent, child``.

    One join a level; nodes that arrived are not joined again. A tree gives each node one parent.
    """
    up = cut(tree.select(F.col("child").alias("at"), "parent").repartition("at"))
    front = cut(nodes.select("id", F.col("id").alias("at")))
    done = front.where(goal).select("id", F.col("at").alias("top"), F.lit(0).alias("levels"))
    for level in range(1, most_levels + 1):
        front = cut(front.where(~goal).join(up, "at").select("id", F.col("parent").alias("at")))
        if front.isEmpty():
            break
        done = done.unionByName(front.where(goal).select("id", F.col("at").alias("top"), F.lit(level).alias("levels")))
    return done


def sizes(symbols: DataFrame, member_of: DataFrame) -> DataFrame:
    """``owner, symbols, lines`` of ``id, first_line, last_line``; a span that ends before it begins has no lines. ``member_of``: ``id, owner``."""
    lines = F.greatest(F.col("last_line") - F.col("first_line") + 1, F.lit(0))
    return symbols.join(member_of, "id").groupBy("owner").agg(F.count(F.lit(1)).alias("symbols"), F.sum(lines).alias("lines"))


def folder_churn(changed: DataFrame) -> DataFrame:
    """``folder, files``: distinct changed paths below each folder, at any depth; paths are made distinct before their folders are listed."""
    return changed.select("path").distinct().select(F.explode(folders_of(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def module_tree(files: DataFrame) -> DataFrame:
    """``module, level, parent, files, lines`` of all folders above ``path, lines``."""
    rows = files.select(F.explode(folders_of(F.col("path"))).alias("module"), "lines")
    sums = rows.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    return sums.select("module", F.size(F.split("module", "/")).alias("level"), folder_of(F.col("module")).alias("parent"), "files", "lines")


def near(files: DataFrame, symbols: DataFrame, path: str, most_symbols: int = 40, most_siblings: int = 12) -> DataFrame:
    """``what, id`` of a file, its first symbols by line, and its first siblings by path."""
    own = files.where(F.col("path") == path).select(F.lit("file").alias("what"), F.col("path").alias("id"))
    inside = symbols.where(F.col("path") == path).orderBy("line", "id").limit(most_symbols).select(F.lit("symbol"), "id")
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    beside = files.where((folder_of(F.col("path")) == folder) & (F.col("path") != path)).orderBy("path").limit(most_siblings).select(F.lit("sibling"), "path")
    return own.union(inside).union(beside)


def capped(entries: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``kind, name, file`` with at most so many rows of the kinds named, the first by file and name; other kinds are whole."""
    rest = entries.where(~F.col("kind").isin(*limits))
    parts = [entries.where(F.col("kind") == k).orderBy("file", "name").limit(n) for k, n in limits.items()]
    return reduce(DataFrame.unionByName, parts, rest)


def entry_points(parts: dict[str, DataFrame]) -> DataFrame:
    """``kind, name, file`` of the distinct entries that several finders name."""
    return reduce(DataFrame.union, [df.select(F.lit(k).alias("kind"), "name", "file") for k, df in parts.items()]).distinct()


def hot_spots(fan_in: DataFrame, churn: DataFrame, k: int = 5) -> DataFrame:
    """``module, name, score``: the k names of each module whose fan-in times the module's churn is largest; zero scores don't count.

    ``fan_in``: ``module, name, fan_in``; ``churn``: ``module, churn``.
    """
    scored = fan_in.join(churn, "module").select("module", "name", (F.col("fan_in") * F.col("churn")).alias("score")).where("score > 0")
    return smallest_k(scored, ["module"], [F.desc("score"), "name"], k)


def module_report(matrix: DataFrame) -> DataFrame:
    """``module, depends_on, used_by`` by distinct peers of ``src, dst``."""
    out = matrix.groupBy(F.col("src").alias("module")).agg(F.count_distinct("dst").alias("depends_on"))
    into = matrix.groupBy(F.col("dst").alias("module")).agg(F.count_distinct("src").alias("used_by"))
    both = out.join(into, "module", "full")
    return both.select("module", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("depends_on", "used_by")])


#: nodes of a frontier that are sent to the edges; with more both are shuffled
MOST_SENT = 100_000


def reaches(edges: DataFrame, a: str, b: str, most_steps: int = 10_000) -> bool:
    """Whether ``b`` can be reached from ``a``; a new edge b to a would then close a loop.

    Only the frontier is joined, and sent to the edges while it is small, so these stay where they are; ``edges`` should be stored.
    """
    seen = front = edges.sparkSession.createDataFrame([(a,)], "id string")
    few = True
    for _ in range(most_steps):
        met = F.broadcast(front) if few else front
        step = edges.select("src", "dst").join(met, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti"))
        n = front.count()
        if n == 0:
            return False
        if not front.where(F.col("id") == b).isEmpty():
            return True
        few = n <= MOST_SENT
        seen = cut(seen.union(front))
    raise RuntimeError(f"paths of over {most_steps} steps")


def connected(links: DataFrame, chosen: DataFrame, kinds: list[str]) -> DataFrame:
    """``id`` of nodes outside ``chosen`` that a link of one of the kinds joins to it, either way."""
    own = links.where(F.col("kind").isin(*kinds))
    out = own.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = own.join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return out.union(into).distinct().join(chosen, "id", "left_anti")


def first_owner(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Each member with ``owner``: the first class of its file that has the name of its parent, else the file itself.

    ``members``: ``id, path, parent_name``; ``classes``: ``id, path, name, line``.
    """
    first = classes.groupBy("path", F.col("name").alias("parent_name")).agg(F.min(F.struct("line", "id")).alias("c"))
    return members.join(first, ["path", "parent_name"], "left").select("id", F.coalesce("c.id", "path").alias("owner"))


def self_targets(sites: DataFrame, members: DataFrame) -> DataFrame:
    """``site, id``: the member that a call on the caller's own object means, if its owner has exactly one of the name.

    ``sites``: ``site, owner, name``; ``members``: ``id, owner, name``.
    """
    only = members.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return sites.join(only, ["owner", "name"]).select("site", "id")


def route_handlers(routes: DataFrame, defs: DataFrame) -> DataFrame:
    """``route, id, tier``: the first definition of the handler's name in the route's file (2), else the only one anywhere (1).

    ``routes``: ``route, path, name``; ``defs``: ``id, path, name, line``.
    """
    here = defs.groupBy("path", "name").agg(F.min(F.struct("line", "id")).alias("own"))
    only = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("far")).where("n = 1")
    both = routes.join(here, ["path", "name"], "left").join(only, "name", "left")
    return both.select("route", F.coalesce("own.id", "far").alias("id"), F.when(F.col("own").isNotNull(), 2).otherwise(1).alias("tier")).where("id is not null")


def layered(notes: DataFrame, task: Column, workflows: dict[str, Column]) -> DataFrame:
    """``notes`` with ``scope`` and ``scope_name``: the task's, else the first workflow's that fits, else the repository's."""
    name = F.coalesce(*[F.when(fits, F.lit(w)) for w, fits in workflows.items()])
    task = F.coalesce(task, F.lit(False))
    return notes.withColumns({
        "scope": F.when(task, "task").when(name.isNotNull(), "workflow").otherwise("repo"),
        "scope_name": F.when(task | name.isNull(), "").otherwise(name),
    })


def best_manifests(found: DataFrame) -> DataFrame:
    """``folder, name``: of the manifests ``folder, name, rank`` of a folder the first by rank."""
    return found.groupBy("folder").agg(F.min(F.struct("rank", "name")).alias("m")).select("folder", "m.name")


def gaps(trials: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Adds ``gap``: seconds since the latest trial before, none below 0; the first has 0."""
    from pyspark.sql.window import Window

    before = F.max(at).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return trials.withColumn("gap", F.coalesce(F.greatest(F.col(at) - before, F.lit(0)), F.lit(0)))
