"""References and calls by name, linked to what they most likely mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import packages
from weftgraph.operators.ranking import smallest_k
from weftgraph.session import cut, dealt, stored, wide


def suffixes(path: Column) -> Column:
    """All tails of a path that start at a folder, itself first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref, rung, id`` of each ``ref``; the first rung that finds anything gives all it finds.

    ``nodes`` has ``id, path, name, owner``. Rungs: 1 the id; 2 a path's tail, ``:``, the name; 3 the same with the
    owner before the name; 4 the name; 5 owner and name; 6 a path or its tail.
    """
    at = lambda rung, ref: F.struct(F.lit(rung).alias("rung"), ref.alias("key"))
    name, owned = F.col("name"), F.concat("owner", F.lit("."), "name")
    tails = F.coalesce(suffixes(F.col("path")), F.array().cast("array<string>"))
    keys = F.concat(
        F.array(at(1, F.col("id")), at(4, name), at(5, owned)),
        F.transform(tails, lambda t: at(2, F.concat(t, F.lit(":"), name))),
        F.transform(tails, lambda t: at(3, F.concat(t, F.lit(":"), owned))),
        F.transform(tails, lambda t: at(6, t)),
    )
    keys = nodes.select("id", F.inline(keys)).where("key is not null")
    dotted = F.regexp_replace("ref", "::|#", ".")  # Owner::name and Owner#name mean Owner.name
    asked = refs.select("ref", F.explode(F.array_distinct(F.array("ref", dotted))).alias("key")).distinct()
    found = asked.join(keys, "key").where("key = ref or rung in (3, 5)").select("ref", "rung", "id").distinct()
    best = found.groupBy("ref").agg(F.min("rung").alias("rung"))
    return found.join(best, ["ref", "rung"])


def resolve_one(refs: DataFrame, nodes: DataFrame, most_candidates: int = 5) -> DataFrame:
    """``ref, status, id, candidates``: the one node that a ref means, or the first few if there are several, or none."""
    found = cut(resolve(refs, nodes).select("ref", "id").distinct())
    counts = found.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    few = smallest_k(found, ["ref"], ["id"], most_candidates).groupBy("ref").agg(F.array_join(F.sort_array(F.collect_list("id")), " ").alias("few"))
    both = refs.select("ref").distinct().join(counts, "ref", "left").join(few, "ref", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "one").otherwise("several")
    return both.select("ref", status.alias("status"), F.when(F.col("n") == 1, F.col("first")).otherwise(F.lit("-")).alias("id"), F.when(F.col("n") > 1, F.col("few")).otherwise(F.lit("")).alias("candidates"))


def link_names(sites: DataFrame, defs: DataFrame, imports: DataFrame, common: list[str], most_guesses: int = 3) -> DataFrame:
    """``site, id, weight, tier`` of calls by bare name.

    ``sites``: ``site, caller, name, path, family``; ``defs``: ``id, name, path, family``; ``imports``: ``path, target``.
    Definitions of the caller's own file come first, then those of imported files, then at most three of the family.
    A name in ``common`` only links within its file. Several targets share a weight of 1 and are guesses.
    Which definitions a name means in a file is found once for all its sites there.
    """
    d = defs.select("id", F.col("path").alias("target"), "name", "family", *([F.col("name").isin(*common).alias("common")] if common else [F.lit(False).alias("common")]))
    return link_keyed(sites.select("site", "caller", "name", "path", "family"), d, imports, ["site"], ["name", "family"], most_guesses).select("site", "id", "weight", "tier")


def link_keyed(sites: DataFrame, defs: DataFrame, imports: DataFrame, site: list[str], keys: list[str], most_guesses: int = 3, parts: int | None = None) -> DataFrame:
    """``link_names`` where columns ``keys`` stand for name and family, and columns ``site`` for the site; further columns of ``defs`` stay.

    ``sites``: ``caller, path``, site and keys; ``defs``: ``id, target, common`` and keys. Sites of one path that have the same keys mean the same, so
    definitions meet those classes, and each site takes its class's answer: a site is shuffled once, and what it means isn't counted
    for it. A site of several rows (it may have several paths or keys) has its ranks counted by itself. With ``parts`` sites are dealt by ``site`` already.
    """
    more = [c for c in defs.columns if c not in ("id", "target", "common", *keys)]
    # a site without a path still has guesses: it is of a class beside all paths
    nowhere, path = F.col("path").isNull().alias("nowhere"), F.coalesce("path", F.lit(0).cast(sites.schema["path"].dataType)).alias("path")
    rows = F.count(F.lit(1)).over(Window.partitionBy(*site))
    sites = stored(sites.select(*dict.fromkeys(["caller", *site, *keys]), path, nowhere).withColumn("rows", rows))
    at = [*keys, "path", "nowhere"]
    side = lambda df, *by: wide(dealt(df, parts, *by))
    classes = stored(sites.select(*at).distinct())
    free, somewhere = defs.where("not common"), classes.where("not nowhere")
    few = free.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most_guesses).select(*keys)
    hit = lambda df, rank: df.select(*at, "id", *more, F.lit(rank).alias("rank"))
    local = hit(somewhere.join(wide(defs.withColumnRenamed("target", "path")), [*keys, "path"]), 1)
    far = hit(somewhere.join(imports.distinct(), "path").join(wide(free), [*keys, "target"]), 2)
    guess = hit(classes.join(wide(few), keys).join(wide(free), keys), 3)
    hits = stored(local.union(far).union(guess))

    ranks = stored(hits.groupBy(*at, "rank").agg(F.count(F.lit(1)).alias("n")))
    first = lambda df, by: df.groupBy(*by).agg(F.min(F.struct("rank", "n")).alias("b")).select(*by, "b.rank", "b.n")
    told = hits.join(wide(first(ranks, at)), [*at, "rank"])
    lone = side(sites.where("rows = 1"), *at).join(side(told, *at), at)
    several = sites.where("rows > 1")
    counted = several.join(wide(ranks), at).groupBy(*site, "rank").agg(F.sum("n").alias("n"))
    several = several.join(wide(hits), at).join(wide(first(counted, site)), [*site, "rank"])
    out = dict.fromkeys([*site, "id", *more])
    columns = ["caller", *(c for c in out if c != "caller"), "rank", "n"]
    found = lone.select(*columns).union(several.select(*columns)).where("id <> caller")
    tier = F.when((F.col("n") > 1) | (F.col("rank") == 3), 0).otherwise(1)
    return found.select(*out, F.round(1 / F.col("n"), 6).alias("weight"), tier.alias("tier"))


def chase(aliases: DataFrame, most_steps: int = 5) -> DataFrame:
    """``name, target, steps`` of re-exports ``name, target`` followed to their ends; a name in a cycle has no end.

    One join a step; only names that moved are joined again.
    """
    one = cut(aliases.select("name", "target").distinct())
    front, done = one.withColumn("steps", F.lit(1)), None
    for step in range(2, most_steps + 2):
        onward = one.select(F.col("name").alias("target"), F.col("target").alias("next"))
        ended = front.join(onward, "target", "left_anti").select("name", "target", "steps")
        done = ended if done is None else done.union(ended)
        if step > most_steps:
            break
        front = cut(front.join(onward, "target").select("name", F.col("next").alias("target"), F.lit(step).alias("steps")).distinct())
        if front.isEmpty():
            break
    return done.groupBy("name", "target").agg(F.min("steps").alias("steps"))


def inherited(members: DataFrame, bases: DataFrame, most_steps: int = 5) -> DataFrame:
    """``owner, name, id, steps``: each class with its own and inherited members, the nearest definition of a name.

    ``members``: ``owner, name, id``; ``bases``: ``owner, base``. Ties go to the smallest id.
    """
    up = cut(bases.select("owner", "base").distinct())
    own = members.select("owner", "name", "id")
    reach, found = up.withColumnRenamed("base", "at"), own.withColumn("steps", F.lit(0))
    for step in range(1, most_steps + 1):
        found = found.unionByName(reach.join(wide(own.withColumnRenamed("owner", "at")), "at").select("owner", "name", "id", F.lit(step).alias("steps")))
        reach = cut(reach.join(up.select(F.col("owner").alias("at"), "base"), "at").select("owner", F.col("base").alias("at")).distinct())
        if reach.isEmpty():
            break
    return found.groupBy("owner", "name").agg(F.min(F.struct("steps", "id")).alias("m")).select("owner", "name", "m.id", "m.steps")


def declared_and_used(declared: DataFrame, used: DataFrame) -> DataFrame:
    """``name, files, state`` of dependencies: used, unused (declared only) or undeclared (imported only).

    ``declared``: ``name``; ``used``: ``name, path``.
    """
    u = used.groupBy("name").agg(F.count_distinct("path").alias("files"))
    both = declared.select("name", F.lit(True).alias("d")).distinct().join(u, "name", "full")
    state = F.when(F.col("d").isNull(), "undeclared").when(F.col("files").isNull(), "unused").otherwise("used")
    return both.select("name", F.coalesce("files", F.lit(0)).alias("files"), state.alias("state"))


def package_report(imports: DataFrame, targets: DataFrame, declared: DataFrame) -> DataFrame:
    """``ecosystem, name, files, state`` from raw imports to a verdict: used, unused (declared only) or undeclared (imported only).

    ``imports``: ``site, path, lang, raw``; ``targets``: ``site`` of those that lead to a file of the tree; ``declared``: ``ecosystem, name``.
    Names are written as code writes them; modules of a runtime are no packages. Packages are cut to one row a file before they meet.
    """
    outside = imports.join(targets.select("site").distinct(), "site", "left_anti")
    eco = packages.ecosystem(F.col("lang"))
    named = outside.select("path", eco.alias("ecosystem"), packages.package_name(F.col("raw"), F.col("lang")).alias("name")).where("name is not null").distinct()
    used = named.where(~packages.runtime_module(F.col("ecosystem"), F.col("name"))).select("path", "ecosystem", packages.imported_as(F.col("ecosystem"), F.col("name")).alias("name"))
    key = lambda df: df.withColumn("name", F.concat_ws("\x1f", "ecosystem", "name"))
    told = declared.select("ecosystem", packages.imported_as(F.col("ecosystem"), F.col("name")).alias("name"))
    out = declared_and_used(key(told), key(used))
    return out.select(F.split("name", "\x1f")[0].alias("ecosystem"), F.split("name", "\x1f")[1].alias("name"), "files", "state")
