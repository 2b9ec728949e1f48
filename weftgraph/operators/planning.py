"""Plans over modules: slices with their order, and areas of a tree of files."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut

#: a plan has a slice a module; beyond so many it is refused
MOST_SLICES = 10_000
# How many areas a tree is cut into, and how many groups of folders there are, of which none should hold more than its share.
ENOUGH_AREAS, MOST_AREAS = 18, 28
MOST_GROUPS, GROUP_SHARE, EXTRA_GROUPS = 12, 0.3, 4


def slices(hits: DataFrame, module_of: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, files, deps`` of a plan: one slice a module with hits, depending on the modules that it uses one way only.

    ``hits``: ``path``; ``module_of``: ``path, module``; ``edges``: ``src, dst`` between modules. Deps are sorted.
    """
    own = cut(hits.select("path").distinct().join(module_of, "path").groupBy(F.col("module").alias("id")).agg(F.count(F.lit(1)).alias("files")))
    arcs = edges.where("src <> dst").select("src", "dst").distinct()
    arcs = cut(arcs.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi"))
    one_way = arcs.join(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    deps = one_way.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("deps"))
    return own.join(deps, "id", "left").select("id", "files", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))


def in_order(plan: DataFrame, most: int = MOST_SLICES) -> DataFrame:
    """``step, id`` of ``id, deps``: always the first slice by id whose deps are done; if all are blocked, the first one.

    Each choice depends on all before it, so the names of the slices, of which a plan has few, are ordered by the
    driver, from a heap of those that wait for nothing; more than ``most`` raise an error.
    """
    rows = plan.select("id", "deps").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a plan has at most {most} slices")
    waits, needed_by = {r.id: set(r.deps) - {r.id} for r in rows}, defaultdict(list)
    for i, deps in waits.items():
        for d in deps:
            needed_by[d].append(i)
    by_id, free, done = iter(sorted(waits)), [i for i, deps in waits.items() if not deps], []
    heapq.heapify(free)
    taken = set()
    while len(done) < len(waits):
        # deps that are no slices are never done, so only the forced choice frees what waits for them
        pick = heapq.heappop(free) if free else next(i for i in by_id if i not in taken)
        taken.add(pick)
        done.append(pick)
        for i in needed_by[pick]:
            waits[i].discard(pick)
            if not waits[i] and i not in taken:
                heapq.heappush(free, i)
    return plan.sparkSession.createDataFrame(list(enumerate(done)), "step int, id string")


def territories(files: DataFrame, enough: int = ENOUGH_AREAS, most: int = MOST_AREAS) -> DataFrame:
    """``area, files``: a tree of ``path`` cut into folders, the largest split into its children until there are ``enough``.

    A split that would give over ``most`` areas is not made. A file belongs to the deepest area that holds it; areas
    without files of their own go. Files are counted by folder once; only names of areas and counts, at most ``most``
    of them, reach the driver.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(".")
    counts = cut(files.select("path").distinct().groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")))
    areas, tried = ["."], set()

    def owner():
        found = F.lit(".")
        for area in sorted(areas, key=lambda a: a.count("/")):  # the deepest one is asked first
            if area != ".":
                found = F.when((F.col("folder") == area) | F.col("folder").startswith(area + "/"), area).otherwise(found)
        return found

    while len(areas) < enough:
        sizes = {r.area: r.n for r in counts.groupBy(owner().alias("area")).agg(F.sum("n").alias("n")).collect()}
        open_areas = [a for a in sizes if a not in tried]
        if not open_areas:
            break
        big = min(open_areas, key=lambda a: (-sizes[a], a))
        tried.add(big)
        within = counts.where((owner() == big) & (F.col("folder") != big))
        start = 1 if big == "." else len(big) + 2
        child = F.substring_index(F.expr(f"substring(folder, {start})"), "/", 1)
        kids = within.select((child if big == "." else F.concat(F.lit(big + "/"), child)).alias("kid")).distinct().limit(most + 1).collect()
        if kids and len(areas) + len(kids) <= most:
            areas += [r.kid for r in kids]
    return counts.groupBy(owner().alias("area")).agg(F.sum("n").alias("files"))


def typed_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, src_file, dst_file, base`` of edges ``src, dst, kind``: imports, uses of types, or calls.

    ``nodes``: ``id, kind, file``. Edges with an end that is no node drop out.
    """
    a = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    b = nodes.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"), F.col("kind").alias("dst_kind"))
    base = F.when(F.col("kind") == "IMPORTS", "imports").when(F.col("dst_kind").isin("class", "interface"), "types").otherwise("calls")
    return edges.where("kind in ('CALLS', 'IMPORTS')").join(a, "src").join(b, "dst").select("src", "dst", "src_file", "dst_file", base.alias("base"))


def groups(files: DataFrame, most: int = MOST_GROUPS, share: float = GROUP_SHARE, extra: int = EXTRA_GROUPS) -> DataFrame:
    """``grp, files``: files ``path`` by folder, where a group with ``share`` of all files or more is split into its subfolders.

    At most ``most`` groups come of it. A folder without subfolders that still holds ``share`` is shown as its files, if these
    are at most ``extra`` above. Files are counted by folder once; only names of groups and of their children reach the
    driver, at most ``most`` and ``extra`` of them.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(".")
    known = files.select("path", folder.alias("folder"))
    counts = cut(known.groupBy("folder").agg(F.count(F.lit(1)).alias("n")))
    top = F.substring_index("folder", "/", 1)
    tops = [r[0] for r in counts.select(top.alias("t")).distinct().limit(most + extra + 1).collect()]
    # so many folders at the root aren't split; they aren't listed then
    wide = len(tops) > most + extra

    def owner(areas: list[str]):
        found = top if wide else F.lit(".")
        for area in sorted(areas, key=lambda a: a.count("/")):
            if area != ".":
                found = F.when((F.col("folder") == area) | F.col("folder").startswith(area + "/"), area).otherwise(found)
        return found

    areas = [] if wide else tops
    total = counts.agg(F.sum("n")).first()[0] or 0
    while True:
        sizes = counts.groupBy(owner(areas).alias("a")).agg(F.sum("n").alias("n")).where(F.col("n") >= share * total).select("a", "n").collect()
        for big, _ in sorted(sizes, key=lambda r: (-r[1], r[0])):
            start = 1 if big == "." else len(big) + 2
            name = F.substring_index(F.expr(f"substring(folder, {start})"), "/", 1)
            within = counts.where(owner(areas) == big)
            kids = [r[0] for r in within.where(F.col("folder") != big).select((name if big == "." else F.concat(F.lit(big + "/"), name)).alias("k")).distinct().limit(most + 1).collect()]
            direct = not within.where(F.col("folder") == big).isEmpty()
            if not wide and kids and len(kids) + direct >= 2 and len(areas) - 1 + len(kids) + direct <= most:
                areas = [a for a in areas if a != big or direct] + kids
                break
        else:
            break
    flat = []
    for big, _ in sizes:
        own = [r[0] for r in known.where((owner(areas) == big) & (F.col("folder") == big)).select("path").distinct().limit(most + extra + 2).collect()]
        if not wide and len(own) >= 2 and len(areas) - 1 + len(own) <= most + extra:
            flat.append(big)
    alone = F.col("folder").isin(*flat) & (owner(areas) == F.col("folder")) if flat else F.lit(False)
    return known.groupBy(F.when(alone, F.col("path")).otherwise(owner(areas)).alias("grp")).agg(F.count(F.lit(1)).alias("files"))


def seat_scopes(scopes: DataFrame, flow_files: DataFrame) -> DataFrame:
    """``seat, prefix``: what each seat of a team works on: files ``path`` of the chosen flows in its own scope; where there are none, its own scope.

    ``scopes``: ``seat, prefix``; a null prefix or ``.`` is everything.
    """
    own = scopes.select("seat", F.coalesce("prefix", F.lit(".")).alias("prefix")).distinct()
    # a path meets the prefixes that it lies under, each of which is all, one of its folders, or itself
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    under = flow_files.select("path").distinct().select("path", F.explode(above).alias("at"))
    both = cut(own.withColumn("at", F.regexp_replace("prefix", "/+$", "")).join(under, "at").select("seat", F.col("path").alias("prefix")).distinct())
    return both.union(own.join(both.select("seat").distinct(), "seat", "left_anti"))


def hand_off_deps(pairs: DataFrame, most: int = MOST_SLICES) -> DataFrame:
    """``id, needs`` of hand-offs ``rank, from, to``: the receiver waits for the one that hands off.

    They are taken by rank, and one that would close a loop with those before it is dropped. As each choice depends on
    all before it, the driver makes it, over at most ``most`` pairs of seats; more raise an error.
    """
    rows = pairs.orderBy("rank", "from", "to").select("from", "to").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a team has at most {most} hand-offs")
    waits: dict[str, set[str]] = {}
    for giver, taker in rows:
        left, seen = [giver], set()
        while left:
            at = left.pop()
            if at not in seen:
                seen.add(at)
                left += waits.get(at, ())
        if taker not in seen:
            waits.setdefault(taker, set()).add(giver)
    return pairs.sparkSession.createDataFrame([(a, b) for a, bs in sorted(waits.items()) for b in sorted(bs)], "id string, needs string")
