"""Uses of declared tables in code: models that a file can see, and tables that its SQL texts name. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.bloom import bloom_filter
from weftgraph.operators.resolution import import_files, stem
from weftgraph.session import cut
from weftgraph.sources import table_scan
from weftgraph.sources.bindings import named_imports
from weftgraph.sources.definitions import HIDDEN, SCRIPTS, _parts, blank, code, line_scopes

_IMPORT = {
    "script": r"(?:(?<=\n)|\A)[ \t]*(?:import|export)\b[^;'\"`(]*?\bfrom\b[^;\n]*|(?:(?<=\n)|\A)[ \t]*import\b[^\n]*",
    "python": r"(?:(?<=\n)|\A)[ \t]*from[ \t]+\S+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n]*)|(?:(?<=\n)|\A)[ \t]*import\b[^\n]*",
}
# What the client of a schema kit is called.
CLIENTS = ("prisma", "db")
_TOKEN = rf"(?:\b({'|'.join(CLIENTS)})\.)?([A-Za-z_$][\w$]*)"
_NAMED = rf"(?i)\b(?:from|join|into|update)\s+((?:{table_scan._NAME}\.)*{table_scan._NAME})"


def family(lang: Column) -> Column:
    """Languages that can use each other's models."""
    return F.when(lang.isin(*SCRIPTS), "script").when(lang == "python", "python")


def _kept(text: Column, pattern: str, keep: bool) -> Column:
    """A text of which only what a pattern finds stays, or only the rest; all else is blanked, lines stay."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)({pattern})|[^\n]+|\n"), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(rf"(?s)({pattern})|[^\n]+|\n"), F.lit(1))
    return F.array_join(F.transform(F.arrays_zip(pieces.alias("whole"), found.alias("found")), lambda p: F.when((p["found"] != "") == F.lit(keep), p["whole"]).otherwise(blank(p["whole"]))), "")


def _texts(text: Column, style: str) -> Column:
    """A source of which only quoted texts stay."""
    quoted = lambda p: p["found"].rlike("^['\"`]")
    return F.array_join(F.transform(_parts(F.coalesce(text, F.lit("")), HIDDEN[style]), lambda p: F.when(quoted(p), p["whole"]).otherwise(blank(p["whole"]))), "")


def _lines(files: DataFrame, text: Column) -> DataFrame:
    lines = files.select("path", "family", F.posexplode(F.split(text, "\n")).alias("i", "text")).where("text rlike '[A-Za-z_$]'")
    return lines.select("path", "family", (F.col("i") + 1).alias("line"), "text")


def visible_models(sources: DataFrame, models: DataFrame) -> DataFrame:
    """``path, token, table``: the names by which each source can mean a model: its own, imported ones, and those of imported modules.

    ``models``: ``path, table, model``. An import counts if it leads to the model's file, or if it takes the model's name from a file that has no
    model of that name and isn't known, or passes it on; a file that declares another class of the name is a look-alike.
    """
    known = models.where("length(model) > 2").select(F.col("path").alias("file"), "model", "table").join(sources.select(F.col("path").alias("file"), family(F.col("lang")).alias("family")), "file").where("family is not null")
    known = cut(known)
    names = named_imports(sources).withColumn("site", F.concat_ws("|", "path", "raw")).withColumn("family", family(F.col("lang")))
    names = cut(names)
    ends = cut(import_files(names.select("site", "path", "lang", "raw").distinct(), sources.select("path")).select("site", F.col("target").alias("file")))
    classes = sources.where(family(F.col("lang")).isNotNull()).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(code(F.col("text"), F.col("lang")), F.lit(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), F.lit(1))).alias("model")).distinct()
    others = ends.join(classes, "file").join(known.select("file", "model"), ["file", "model"], "left_anti").select("site", "model").distinct()
    own = known.select(F.col("file").alias("path"), F.col("model").alias("token"), "table")
    taken = names.where("exported is not null").withColumnRenamed("exported", "model").join(known, ["model", "family"])
    taken = taken.join(others, ["site", "model"], "left_anti").select("path", F.col("local").alias("token"), "table")
    through = names.where("exported is null").join(ends, "site").join(known, ["file", "family"]).select("path", F.col("model").alias("token"), "table")
    # a module that is taken by its name: from app import models
    part = names.where("exported is not null").join(known, (F.col("exported") == F.element_at(F.split(stem(F.col("file")), "/"), -1)) & (names["family"] == known["family"])).select("path", F.col("model").alias("token"), "table")
    return own.union(taken).union(through).union(part).distinct()


def table_uses(sources: DataFrame) -> DataFrame:
    """``path, symbol, table, line`` of the first use of each declared table in each function or class of ``path, lang, text``; no symbol stands for the file.

    Models are met by identifiers in code, outside of imports and comments, that the file can see; those of Prisma behind its client;
    tables by FROM, JOIN, INTO or UPDATE and a name on one line of a quoted text. What declares a table doesn't use it. All of these are inferred.
    The index of identifiers is cut by a Bloom filter of the visible names before it is shuffled.
    """
    models = cut(table_scan.declared_models(sources).distinct())
    tables = cut(models.select("table").union(table_scan.declared_tables(sources).select("table")).distinct())
    files = sources.withColumn("family", family(F.col("lang"))).where("family is not null and not path like '%.prisma'")
    plain = code(F.col("text"), F.col("lang"))
    tokens = F.when(F.col("family") == "python", _kept(plain, _IMPORT["python"], False)).otherwise(_kept(plain, _IMPORT["script"], False))
    lines = _lines(files, tokens)
    found = lines.select("path", "family", "line", F.inline(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(k + 1)).alias(n) for k, n in enumerate(("client", "token"))])))
    visible = cut(visible_models(sources, models.where("model is not null and not path like '%.prisma'")))
    kit = models.where("model is not null and path like '%.prisma'").select(F.concat(F.lower(F.substring("model", 1, 1)), F.substring("model", 2, 1 << 20)).alias("token"), "table").distinct()
    kit = cut(kit)
    wanted = bloom_filter(visible.select("token").union(kit.select("token")), "token")
    index = cut(found.where(wanted(F.col("token"))).distinct())
    by_model = index.join(visible, ["path", "token"]).select("path", "line", "table")
    by_kit = index.where("client <> '' and family = 'script'").join(kit, "token").select("path", "line", "table")
    quoted = F.when(F.col("family") == "python", _texts(F.col("text"), "python")).otherwise(_texts(F.col("text"), "script"))
    told = _lines(files, quoted).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(_NAMED), F.lit(1))).alias("name"))
    told = told.select("path", "line", table_scan.last_part(F.col("name")).alias("table")).join(tables, "table", "left_semi").select("path", "line", "table")
    scopes = line_scopes(files.select("path", "lang", "text")).select("path", "line", F.col("name").alias("symbol"))
    uses = by_model.union(by_kit).union(told).join(scopes, ["path", "line"], "left")
    declares = models.where("model is not null").select("path", F.col("model").alias("symbol"), "table")
    uses = uses.join(declares, ["path", "symbol", "table"], "left_anti")
    # what a module binds to a table at its top level declares it on that line
    at_top = models.where("model is not null").select("path", "table").distinct().withColumn("top", F.lit(True))
    uses = uses.join(at_top, ["path", "table"], "left").where("symbol is not null or top is null")
    return uses.groupBy("path", "symbol", "table").agg(F.min("line").alias("line"))
