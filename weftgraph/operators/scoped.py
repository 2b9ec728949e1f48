"""Scoped paths of Rust: the longest prefix that names a module, aliases and re-exports rewritten until nothing changes.

Paths are texts joined by ``::``. Work is done on the distinct paths of a file, not on its calls. Each round joins all prefixes
of the paths still open with the modules, by equality, so no file or module list is gone through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.resolution import folder, normal
from weftgraph.session import cut

# Words that anchor a path, and how often a path may be rewritten.
ANCHORS = ("crate", "self", "super")
MOST_REWRITES = 12


def _joined(first: Column, rest: Column) -> Column:
    return F.when(first == "", rest).when(rest == "", first).otherwise(F.concat(first, F.lit("/"), rest))


def places(files: DataFrame) -> DataFrame:
    """``path, root, home``: the folder of each file's crate, the nearest with a lib.rs or main.rs, and the folder of its own modules."""
    known = files.select("path").distinct()
    roots = known.where(r"path rlike '(^|/)(lib|main)\\.rs$'").select(folder(F.col("path")).alias("root")).distinct()
    parts = F.split(folder(F.col("path")), "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    nearest = known.select("path", F.explode(F.array_distinct(above)).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    home = F.when(F.col("path").rlike(r"(^|/)(mod|lib|main)\.rs$"), folder(F.col("path"))).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    return known.join(nearest, "path", "left").select("path", F.coalesce("root", F.lit("")).alias("root"), home.alias("home"))


def modules(files: DataFrame, declared: DataFrame) -> DataFrame:
    """``base, file``: the file of each module, by the folder that holds its own modules.

    ``a.rs`` comes before ``a/mod.rs``, lib.rs before main.rs, and a file that a path attribute names before both.
    """
    known = files.select("path").distinct()
    rank = F.when(F.col("path").rlike(r"(^|/)(mod|main)\.rs$"), 2).otherwise(1)
    plain = known.select(F.regexp_replace("path", r"(?:(?:^|/)(?:mod|lib|main))?\.rs$", "").alias("base"), F.struct(rank.alias("rank"), F.col("path").alias("file")).alias("f"))
    named = declared.where("file is not null and not inline").select("path", "local", normal(F.concat(folder(F.col("path")), F.lit("/"), F.col("file"))).alias("file"))
    named = named.join(places(files), "path").join(known.withColumnRenamed("path", "file"), "file", "left_semi")
    named = named.select(_joined(F.col("home"), F.col("local")).alias("base"), F.struct(F.lit(0).alias("rank"), F.col("file")).alias("f"))
    return plain.union(named).groupBy("base").agg(F.min("f")["file"].alias("file"))


def _found(now: DataFrame, mods: DataFrame, declared: DataFrame, at: DataFrame) -> DataFrame:
    """``now`` with ``file`` and ``rest``: the module of the longest prefix and what follows; null and the whole path if there is none.

    All shorter prefixes must be modules too. A first name without anchor must be declared by the file, or by the root of its crate.
    """
    anchors = F.regexp_extract("asked", rf"^((?:(?:{'|'.join(ANCHORS)})(?:::|$))*)", 1)
    said = F.filter(F.split(anchors, "::"), lambda a: a != "")
    rows = now.join(at.withColumnRenamed("path", "at"), "at").withColumn("said", said)
    rows = rows.withColumn("body", F.filter(F.split("asked", "::"), lambda s: s != ""))
    rows = rows.withColumn("body", F.slice("body", F.size("said") + 1, F.size("body"))).withColumn("head", F.get("body", F.lit(0)))
    own = declared.select(F.col("path").alias("at"), F.col("local").alias("head"), F.lit(True).alias("own")).distinct()
    of_root = declared.where(r"path rlike '(^|/)(lib|main)\\.rs$' and not inline").select(folder(F.col("path")).alias("root"), F.col("local").alias("head"), F.lit(True).alias("rooted")).distinct()
    rows = rows.join(own, ["at", "head"], "left").join(of_root, ["root", "head"], "left")
    ups = F.size(F.filter("said", lambda a: a == "super"))
    steps = F.filter(F.split("home", "/"), lambda s: s != "")
    up = F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - ups, F.lit(0))), "/")
    start = F.when(F.array_contains("said", "crate"), F.col("root")).when(F.size("said") > 0, up).when(F.col("own"), F.col("home")).when(F.col("rooted"), F.col("root"))
    least = F.when(F.size("said") > 0, 0).otherwise(1)
    rows = rows.withColumn("start", start).withColumn("least", least)
    prefixes = F.when(F.col("start").isNotNull() & (F.size("body") >= F.col("least")), F.sequence(F.col("least"), F.size("body")))
    keyed = rows.select("path", "asked0", "at", "asked", "start", "least", "body", F.explode(prefixes).alias("k"))
    keyed = keyed.select("path", "asked0", "at", "asked", "least", "k", _joined(F.col("start"), F.array_join(F.slice("body", F.lit(1), F.col("k")), "/")).alias("base"))
    met = keyed.join(mods, "base").groupBy("path", "asked0", "at", "asked").agg(F.min("least").alias("least"), F.sort_array(F.collect_list(F.struct("k", "file"))).alias("met"))  # as many as a path has parts
    # a module root may be missing as a file of its own; from there on each part must be one
    first = F.struct(F.col("least") - 1, F.lit(None).cast("string"))
    run = F.aggregate("met", first.cast("struct<k:int,file:string>"), lambda s, x: F.when((x["k"] == s["k"] + 1) | (s["file"].isNull() & (x["k"] <= 1)), F.struct(x["k"].alias("k"), x["file"].alias("file"))).otherwise(s))
    longest = met.select("path", "asked0", "at", "asked", run.alias("run"))
    rows = rows.join(longest, ["path", "asked0", "at", "asked"], "left")
    rest = F.when(F.col("run.file").isNotNull(), F.slice("body", F.col("run.k") + 1, F.size("body"))).otherwise(F.col("body"))
    return rows.select("path", "asked0", "at", "asked", F.size("said").alias("anchored"), F.col("run.file").alias("file"), rest.alias("rest"))


def scoped_targets(asked: DataFrame, files: DataFrame, defs: DataFrame, uses: DataFrame, declared: DataFrame, most_rewrites: int = MOST_REWRITES) -> DataFrame:
    """``path, asked, id``: the one definition that a file's path, or a name that it took from one, means.

    ``asked``: ``path, asked``; ``files``: ``path``; ``defs``: ``id, path, name, owner``, where a type owns its methods; ``uses``: ``path, local, target, public``, where
    ``*`` takes all; ``declared``: ``path, local, inline, file``. In a module's file the only definition of the name counts, else
    the only one that the name before it owns. A name that the file took is rewritten to where it came from, and
    one that a module passes on (``pub use``) to what it means there, over and over; a path that is rewritten more than
    ``most_rewrites`` times runs in a circle and means nothing. Several meanings prove nothing. Names from ``*`` count if one module alone has them.
    """
    files, declared, uses = cut(files.select("path").distinct()), cut(declared.distinct()), cut(uses.distinct())
    at, mods = cut(places(files)), cut(modules(files, declared))
    declared = declared.select("path", "local", "inline").distinct()
    named = uses.where("local <> '*'").select(F.col("path").alias("at"), F.col("local").alias("head"), "target", "public")
    stars = uses.where("local = '*'").select("path", F.regexp_replace("target", r"\*$", "").alias("t")).select("path", F.concat("t", F.lit("*")).alias("asked0"))
    now = asked.select("path", F.col("asked").alias("asked0")).union(stars).distinct()
    now = cut(now.select("path", "asked0", F.col("path").alias("at"), F.col("asked0").alias("asked")))
    defs = cut(defs.select("id", "path", "name", "owner"))
    own = cut(defs.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")))
    done = None
    for _ in range(most_rewrites + 1):
        found = cut(_found(now, mods, declared, at).withColumn("head", F.get("rest", F.lit(0))))
        # heads that no module names may be taken from elsewhere
        taken = found.where("file is null and anchored = 0").join(named.select("at", "head", "target"), ["at", "head"])
        taken = taken.where("target <> head")
        # a module may pass a name on that it doesn't define itself
        inside = found.where("file is not null and (file <> at or anchored > 0)").join(own.select(F.col("path").alias("file"), F.col("name").alias("head")), ["file", "head"], "left_anti")
        passed = inside.join(named.where("public").select(F.col("at").alias("file"), "head", "target"), ["file", "head"])
        onward = lambda df, where: df.select("path", "asked0", F.col(where).alias("at"), F.concat_ws("::", "target", F.array_join(F.slice("rest", F.lit(2), F.size("rest")), "::")).alias("asked"))
        both = onward(taken, "at").union(onward(passed, "file")).withColumn("asked", F.regexp_replace("asked", "::$", ""))
        ended = found.join(taken.select("path", "asked0", "at", "asked").union(passed.select("path", "asked0", "at", "asked")).distinct(), ["path", "asked0", "at", "asked"], "left_anti")
        done = ended if done is None else done.union(ended)
        now = cut(both.distinct())
        if now.isEmpty():
            break
    ends = done.select("path", "asked0", F.col("file").isNull().alias("here"), F.coalesce("file", "at").alias("file"), F.element_at("rest", -1).alias("name"), F.get("rest", F.size("rest") - 2).alias("before")).where("size(rest) > 0 and name <> '*'")
    ends = cut(ends.distinct())
    at_file = own.where("n = 1").select(F.col("path").alias("file"), "name", "id")
    # what ends in its own file without a module is left to the linking by name, but for members of its types
    alone = ends.where("not here").join(at_file, ["file", "name"]).select("path", "asked0", "id", F.lit(1).alias("rule"))
    by_owner = defs.where("owner is not null").groupBy(F.col("path").alias("file"), F.col("owner").alias("before"), "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    owned = ends.join(by_owner, ["file", "before", "name"]).select("path", "asked0", "id", F.lit(2).alias("rule"))
    glob = done.where("file is not null and element_at(rest, -1) = '*'").select("path", "file").distinct()
    bare = ends.where("here and before is null").select("path", "asked0", "name")
    spread = bare.join(glob, "path").join(at_file, ["file", "name"]).select("path", "asked0", "id", F.lit(3).alias("rule"))
    every = cut(alone.union(owned).union(spread).distinct())
    best = every.groupBy("path", "asked0").agg(F.min("rule").alias("rule"))
    only = every.join(best, ["path", "asked0", "rule"]).groupBy("path", "asked0").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    return only.select("path", F.col("asked0").alias("asked"), "id")


def own_paths(calls: DataFrame) -> DataFrame:
    """``calls`` with ``asked, owner`` whose paths through ``Self`` begin with the owner's name instead."""
    return calls.withColumn("asked", F.when(F.col("owner").isNotNull(), F.regexp_replace("asked", F.lit("^Self(?=::)"), F.col("owner"))).otherwise(F.col("asked")))
