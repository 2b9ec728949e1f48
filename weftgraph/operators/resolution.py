"""Imports to files and calls to definitions, as joins on keys; tiers: 0 guessed, 1 inferred, 2 resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.linking import chase, inherited, suffixes
from weftgraph.operators.ranking import smallest_k
from weftgraph.session import cut, stored, wide

SCRIPTS = ("javascript", "typescript", "tsx")
#: languages whose imports name no file
NO_FILES = ("java", "c", "cpp", "csharp", "ruby", "php")
#: folders that hold a crate's sources and tests
CRATE_FOLDERS = ("src", "tests", "benches", "examples")


def normal(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; ``..`` at the root stays there."""
    none = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(none)
    step = lambda done, x: F.when(x == "..", up(done)).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def stem(path: Column) -> Column:
    """The path without the ending of its last part."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def crate(path: Column) -> Column:
    """All before the last of the folders that hold a crate's sources; empty at the root."""
    return F.regexp_extract(path, rf"^(.*/)(?:{'|'.join(CRATE_FOLDERS)})/", 1)


def _shortened(parts: Column, least: Column) -> Column:
    """The first n parts joined, from all down to ``least``."""
    return F.when(F.size(parts) >= least, F.transform(F.sequence(F.size(parts), least, F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def aliased(spec: Column, aliases: tuple[tuple[str, str], ...], base_url: str = "") -> Column:
    """The path that a script's import means by the first alias ``(pattern, target)`` that fits, each with at most one ``*``; else below ``base_url``; null if there is none."""
    root = f"{base_url}/" if base_url else ""
    out = F.concat(F.lit(root), spec) if root else F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        before, star, after = pattern.partition("*")
        if star:
            fits = spec.startswith(before) & spec.endswith(after) & (F.length(spec) >= len(before) + len(after))
            middle = F.substr(spec, F.lit(len(before) + 1), F.greatest(F.length(spec) - len(before) - len(after), F.lit(0)))
        else:
            fits, middle = spec == pattern, F.lit("")
        out = F.when(fits, F.concat(F.lit(root), F.replace(F.lit(target), F.lit("*"), middle))).otherwise(out)
    return out


def import_keys(path: Column, lang: Column, raw: Column, go_module: str = "", aliases: tuple[tuple[str, str], ...] = (), base_url: str = "") -> Column:
    """What an import may mean: ``array<struct<key, loose>>``, the best first.

    A key is the stem of a file; a loose one may also be the tail of a stem. Go's are folders, marked by a last ``/``.
    Scripts' imports that aren't relative go by ``aliases`` and ``base_url``.
    """
    s = F.regexp_replace(F.trim(raw), r"^[\"'`]+|[\"'`]+$", "")
    here = folder(path)
    keys = lambda a, loose: F.transform(a, lambda k: F.struct(k.alias("key"), F.lit(loose).alias("loose")))
    none = keys(F.array().cast("array<string>"), False)

    beside = normal(F.concat(here, F.lit("/"), s))
    meant = stem(F.when(s.startswith("."), beside).otherwise(normal(aliased(s, aliases, base_url))))
    script = F.when(meant.isNotNull() & (s != ""), keys(F.array(meant, F.concat(meant, F.lit("/index"))), False)).otherwise(none)

    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    body = F.translate(F.regexp_replace(s, r"^\.+", ""), ".", "/")
    home = normal(F.concat(here, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))), F.lit("/"), body))
    init = lambda k: F.array(k, F.concat(k, F.lit("/__init__")))
    python = F.when(dots > 0, keys(init(home), False)).when(body != "", keys(init(body), True)).otherwise(none)

    use = F.regexp_replace(F.regexp_replace(s, r"(?s)\{.*", ""), "(::)+$", "")
    parts = F.filter(F.split(use, "::"), lambda p: ~p.isin("crate", "self", "super", "", "*"))
    base = F.when(path.rlike("(mod|main|lib)\\.rs$"), here).otherwise(stem(path))
    own = normal(F.concat(base, F.lit("/"), parts[0]))
    both = F.flatten(F.transform(_shortened(parts, F.lit(1)), lambda k: F.array(k, F.concat(k, F.lit("/mod")))))
    rust = F.when((F.size(parts) == 1) & ~s.contains("::"), keys(F.array(own, F.concat(own, F.lit("/mod"))), False)).otherwise(keys(both, True))

    inside = s.startswith(go_module) & F.substring(s, len(go_module) + 1, 1).isin("", "/") if go_module else F.lit(False)
    package = F.regexp_replace(F.expr("''") if not go_module else F.substring(s, len(go_module) + 1, 1 << 20), "^/+", "")
    go = F.when(inside, keys(F.array(F.concat(package, F.lit("/"))), False)).otherwise(none)

    bare = F.regexp_replace(s, r"^[<>() ]+|[<>() ]+$", "")
    named = F.when(bare.contains("/"), stem(bare)).otherwise(F.regexp_replace(bare, r"::|[:.]", "/"))
    steps = F.filter(F.split(named, "/"), lambda p: ~p.isin("", "*"))
    other = F.when((bare == "") | bare.rlike(r"\s"), none)
    other = other.when(bare.rlike(r"^\.\.?/"), keys(F.array(stem(normal(F.concat(here, F.lit("/"), bare)))), False))
    other = other.otherwise(keys(_shortened(steps, F.when(F.size(steps) > 2, 2).otherwise(1)), True))
    return F.when(lang.isin(*SCRIPTS), script).when(lang == "python", python).when(lang == "rust", rust).when(lang == "go", go).when(lang.isin(*NO_FILES), none).otherwise(other)


def import_files(
    imports: DataFrame, files: DataFrame, go_module: str = "", most: int = 4, most_in_folder: int = 12, aliases: tuple[tuple[str, str], ...] = (), base_url: str = ""
) -> DataFrame:
    """``site, target, tier`` of imports ``site, path, lang, raw``; ``files`` has ``path``.

    The first key that names a file counts: exactly (2), else as the tail of one stem of several folders (1), else it
    is a guess (0), of the first few by path. Rust stays in its crate where it can and never enters another's tests. Go
    means the files of a folder of ``go_module``.
    All tails of stems are one table; each import meets it once, on its own keys. Tails with very many files are cut
    to the few that can be wanted before they meet the imports.
    """
    known = stored(files.select("path").distinct())
    exact = known.select(stem(F.col("path")).alias("key"), F.col("path").alias("target"))
    packages = smallest_k(known.select(F.concat(folder(F.col("path")), F.lit("/")).alias("key"), F.col("path").alias("target")), ["key"], ["target"], most_in_folder)
    tails = known.select(F.explode(suffixes(stem(F.col("path")))).alias("key"), F.col("path").alias("target")).where(F.col("key") != stem(F.col("target")))
    tails = stored(tails.select("key", "target", crate(F.col("target")).alias("home"), F.array_contains(F.split("target", "/"), "tests").alias("test")))
    # the first few of a tail, of each crate, with and without tests, are all that any import takes
    anywhere = smallest_k(tails.select("key", "target"), ["key"], ["target"], most)
    in_crate = smallest_k(tails.select("key", "home", "target"), ["key", "home"], ["target"], most)
    abroad = smallest_k(tails.select("key", "test", "target"), ["key", "test"], ["target"], most).select("key", "target")

    asked = imports.select("site", "path", "lang", "raw", F.posexplode(import_keys(F.col("path"), F.col("lang"), F.col("raw"), go_module, aliases, base_url)).alias("rank", "k"))
    asked = stored(asked.select("site", "lang", F.trim("raw").rlike("^[\"'`]*(crate|self|super)::").alias("anchored"), crate(F.col("path")).alias("home"), "rank", F.col("k.key").alias("key"), F.col("k.loose").alias("loose")))
    columns = ["site", "lang", "anchored", "home", "loose", "key", "rank", "target"]
    sure = asked.join(wide(exact.union(packages)), "key").select(*columns, F.lit(True).alias("sure"))
    missed = asked.where("loose").join(wide(exact.select("key").distinct()), "key", "left_anti")
    loose = missed.where("lang <> 'rust'").join(wide(anywhere), "key").select(*columns, F.lit(False))
    rust = missed.where("lang = 'rust'")
    mine = rust.join(wide(in_crate), ["key", "home"]).select(*columns, F.lit(False)).union(rust.join(wide(abroad), "key").select(*columns, F.lit(False))).distinct()
    found = stored(sure.union(loose).union(mine))

    # of a shortened path the name comes before the folder's own file, then crates are told apart
    level = F.when((F.col("lang") == "rust") & F.col("loose"), F.expr("rank div 2")).otherwise(F.col("rank"))
    found = found.withColumn("level", level)
    first = found.groupBy("site", "level").agg(F.min("rank").alias("rank"), F.max((F.col("lang") == "rust") & F.col("loose") & (crate(F.col("target")) == F.col("home"))).alias("any_home"))
    found = stored(found.join(wide(first), ["site", "level", "rank"]))
    hits = found.groupBy("site", "level").agg(F.count(F.lit(1)).alias("met"))
    stays = F.when((F.col("lang") != "rust") | ~F.col("loose"), True).when(F.col("any_home") | F.col("anchored"), crate(F.col("target")) == F.col("home")).otherwise(~F.array_contains(F.split("target", "/"), "tests"))
    kept = stored(found.join(wide(hits), ["site", "level"]).where(stays))
    best = kept.groupBy("site").agg(F.min("level").alias("level"))
    kept = stored(kept.join(wide(best), ["site", "level"]))
    own = kept.where("lang = 'rust' and loose").withColumn("sure", F.col("sure") & (F.col("met") == 1))
    kept = kept.where("lang <> 'rust' or not loose").unionByName(smallest_k(own, ["site"], ["target"], most))
    several = kept.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    tier = F.when(F.col("sure"), 2).when((F.col("n") == 1) & F.col("key").contains("/"), 1).otherwise(0)
    return kept.join(wide(several), "site").select("site", "target", tier.alias("tier"))


def _place(path: str, name: str) -> Column:
    return F.concat_ws("\x1f", path, name)


def exports(defs: DataFrame, reexports: DataFrame, most_steps: int = 5) -> DataFrame:
    """``path, name, id``: the one definition that a file gives a name to, its own or a re-exported one.

    ``defs``: ``id, path, name, owner``, those without owner count; ``reexports``: ``path, name, target, exported``.
    A file's own definition comes first; names with several meanings, or whose re-exports run in a circle, have none.
    """
    own = defs.where("owner is null").groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    own = stored(own.select(_place("path", "name").alias("at"), "path", "name", "n", "id"))
    links = reexports.select(_place("path", "name").alias("name"), _place("target", "exported").alias("target")).join(wide(own.select(F.col("at").alias("name"))), "name", "left_anti")
    ends = chase(links, most_steps).join(wide(own.where("n = 1").select(F.col("at").alias("target"), "id")), "target")
    only = ends.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    far = only.select(F.split("name", "\x1f")[0].alias("path"), F.split("name", "\x1f")[1].alias("name"), "id")
    return own.where("n = 1").select("path", "name", "id").unionByName(far)


def structured_calls(calls: DataFrame, defs: DataFrame, bindings: DataFrame, bases: DataFrame, types: DataFrame, reexports: DataFrame) -> DataFrame:
    """``site, id, rule`` of calls that are proven to mean one definition; all others are left to the linking by name.

    ``calls``: ``site, path, scope, owner, receiver, name``; ``defs``: ``id, path, name, owner``; ``bindings``: ``path,
    local, target, exported``, where no ``exported`` binds the module itself; ``bases``: ``owner, base``, by class id;
    ``types``: ``path, scope, local, type``. Rules: 1 a member of the caller's own object or class, 2 an imported name, 3 a
    member of an imported module, 4 of the class of a local variable, 5 of a class called by its name. Inherited
    members count. Two meanings prove nothing.
    """
    given = stored(exports(defs, reexports))
    members = stored(inherited(defs.where("owner is not null").groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).select("owner", "name", F.when(F.col("n") == 1, F.col("id")).alias("id")), bases))
    members = members.where("id is not null").select("owner", "name", "id")
    named = bindings.where("exported is not null").join(wide(given.withColumnsRenamed({"path": "target", "name": "exported"})), ["target", "exported"]).select("path", "local", "id")
    # names of classes that a file can see
    seen = given.select("path", F.col("name").alias("local"), "id").union(named).distinct().withColumnRenamed("id", "class")

    own = calls.where("receiver in ('self', 'this', 'cls')").join(wide(members), ["owner", "name"]).select("site", "id", F.lit(1).alias("rule"))
    direct = calls.where("receiver is null").select("site", "path", F.col("name").alias("local")).join(wide(named), ["path", "local"]).select("site", "id", F.lit(2))
    through = calls.where("receiver not in ('self', 'this', 'cls')").select("site", "path", "scope", F.col("receiver").alias("local"), "name")
    module = through.join(wide(bindings.select("path", "local", "target")), ["path", "local"]).join(wide(given.withColumnRenamed("path", "target")), ["target", "name"]).select("site", "id", F.lit(3))
    typed = through.join(wide(types), ["path", "scope", "local"]).drop("local").join(wide(seen.withColumnRenamed("local", "type")), ["path", "type"])
    typed = typed.join(wide(members.withColumnRenamed("owner", "class")), ["class", "name"]).select("site", "id", F.lit(4))
    bare = through.join(wide(types.select("path", "local").distinct()), ["path", "local"], "left_anti").join(wide(seen), ["path", "local"])
    bare = bare.join(wide(members.withColumnRenamed("owner", "class")), ["class", "name"]).select("site", "id", F.lit(5))
    found = stored(own.union(direct).union(module).union(typed).union(bare).distinct())
    best = found.groupBy("site").agg(F.min("rule").alias("rule"))
    only = found.join(wide(best), ["site", "rule"]).groupBy("site", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return only.where("n = 1").select("site", "id", "rule")


def visible_types(uses: DataFrame, bound: DataFrame) -> DataFrame:
    """``path, scope, local, type`` of the names that ``uses`` (``path, scope, chain, local``) have there.

    The nearest scope of a chain that binds the name decides, as ``bound`` (``path, scope, local, type``) says; if it binds it to no
    type or to several, there is none, whatever the scopes around say. A chain is as long as definitions are nested.
    """
    per_scope = bound.groupBy("path", "scope", "local").agg(F.count_distinct("type").alias("n"), F.max(F.col("type").isNull()).alias("dark"), F.min("type").alias("type"))
    asked = uses.select("path", "scope", "local", "chain").distinct().select("path", F.col("scope").alias("at"), "local", F.posexplode("chain").alias("far", "scope"))
    met = asked.join(wide(per_scope), ["path", "scope", "local"])
    near = met.groupBy("path", "at", "local").agg(F.min_by(F.struct("n", "dark", "type"), "far").alias("t"))
    return near.where("t.n = 1 and not t.dark").select("path", F.col("at").alias("scope"), "local", F.col("t.type").alias("type"))


def interface_targets(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """``site, id`` of calls through an interface: the only method of the name elsewhere, else the interface's own if it is the only one.

    ``calls``: ``site, interface, name``; ``methods``: ``id, owner, name``. It is never more than inferred. Methods are
    counted first, so a frequent name meets no call.
    """
    by_owner = cut(methods.groupBy("name", "owner").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("id")))
    totals = by_owner.groupBy("name").agg(F.sum("own").alias("total"))
    mine = by_owner.select("name", F.col("owner").alias("interface"), "own", F.col("id").alias("own_id"))
    asked = calls.join(totals, "name").join(mine, ["name", "interface"], "left").withColumn("others", F.col("total") - F.coalesce("own", F.lit(0)))
    far = asked.where("others = 1").select("site", "interface", "name").join(by_owner.select("name", "owner", "id"), "name").where("owner <> interface").select("site", "id")
    return far.union(asked.where("others = 0 and own = 1").select("site", "own_id"))


def merged_calls(structured: DataFrame, soft: DataFrame, named: DataFrame) -> DataFrame:
    """``site, id, weight, tier``: proven calls, then soft ones, then those linked by name whose site is claimed by neither."""
    hard = structured.select("site", "id", F.lit(1.0).alias("weight"), F.lit(2).alias("tier"))
    claimed = structured.select("site")
    extra = soft.join(claimed, "site", "left_anti").select("site", "id", F.lit(1.0), F.lit(1))
    rest = named.join(claimed.union(soft.select("site")).distinct(), "site", "left_anti").select("site", "id", "weight", "tier")
    return hard.union(extra).union(rest)
