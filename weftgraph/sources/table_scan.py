"""Tables that SQL scripts and models of object mappers declare, and uses of the former, found by patterns on whole texts; no parser, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that may stand between CREATE and TABLE, and before the name.
MODIFIERS = ("or", "replace", "temp", "temporary", "unlogged", "global", "local")
GUARDS = (r"if\s+not\s+exists", r"if\s+exists", "only")
#: quoted texts, comments, or a name quoted in one of three ways
_NAME = r'(?:"[^"\n]+"|`[^`\n]+`|\[[^\]\n]+\]|[A-Za-z_]\w*)'
_HIDDEN = r"(?s)--[^\n]*|/\*.*?(?:\*/|\z)|'(?:[^']|'')*(?:'|\z)"
_DECLARED = rf"(?i)\b(?:create\s+(?:(?:{'|'.join(MODIFIERS)})\s+)*|alter\s+)table\s+(?:(?:{'|'.join(GUARDS)})\s+)*((?:{_NAME}\.)*{_NAME})"
_USED = rf"(?i)\b(?:from|join|into|update)\s+(?:only\s+)?((?:{_NAME}\.)*{_NAME})"


def plain_sql(text: Column) -> Column:
    """A script without comments and quoted texts; each leaves a blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _HIDDEN, " ")


def last_part(name: Column) -> Column:
    """The last part of a qualified name, without quotes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(name, rf"({_NAME})$", 1), r'^["`\[]|["`\]]$', ""))


def _named(sources: DataFrame, pattern: str) -> DataFrame:
    found = sources.select("path", F.explode(F.regexp_extract_all(plain_sql(F.col("text")), F.lit(pattern), F.lit(1))).alias("name"))
    return found.select("path", last_part(F.col("name")).alias("table")).where("length(table) between 1 and 128")


def declared_tables(sources: DataFrame) -> DataFrame:
    """``path, table, times`` that scripts ``path, text`` ending in ``.sql`` create or alter."""
    return _named(sources.where(F.col("path").endswith(".sql")), _DECLARED).groupBy("path", "table").agg(F.count(F.lit(1)).alias("times"))


def used_tables(sources: DataFrame) -> DataFrame:
    """``path, table, declared_in``: tables behind FROM, JOIN, INTO or UPDATE that a script declares; ties to the first path."""
    first = declared_tables(sources).groupBy("table").agg(F.min("path").alias("declared_in"))
    return _named(sources.where(F.col("path").endswith(".sql")), _USED).distinct().join(first, "table").select("path", "table", "declared_in")


#: the text in quotes behind blanks, brackets, an equals sign and a label
_GIVEN = r"""[\s(=]*(?:name:\s*)?["'`]([^"'`]{1,128})["'`]"""
_MODEL = r"(?ms)^\s*model\s+(\w+)[^\n]*\n(.*?)^\s*\}"
#: a longer text in three quotes, or a class at the left edge with all lines up to the next one there
_CLASS = r'(?ms)""".*?(?:"""|\z)|\'\'\'.*?(?:\'\'\'|\z)|^class[ \t]+(\w+)((?:\([^)]*\))?[^\n]*)((?:\n(?:[ \t\r)\]][^\n]*)?(?=\n|\z))*)'
# Functions of schema kits that declare a table, and those that make such functions.
KITS = ("pgTable", "mysqlTable", "sqliteTable")
MAKERS = ("pgTableCreator", "mysqlTableCreator", "sqliteTableCreator")
_CREATOR = rf"(\w+)\s*=\s*(?:{'|'.join(MAKERS)})\([^`]{{0,200}}`([^`$]*)\$\{{[^}}`]*\}}([^`]*)`"
#: comments and quoted texts, or a call that a name may be bound to, with a quoted text first
_CALL = rf"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|(?:(\w+)\s*=\s*)?(?<!\w)(?:\w+(\.))?(\w+)\({_GIVEN}|'[^'\n]*'|"[^"\n]*"|`[^`]*`"""


def _groups(text: Column, pattern: str, *names: str) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def _row(model: Column, table: Column) -> Column:
    return F.struct(F.lower(table).alias("table"), F.when(model != "", model).alias("model"))


def _schema_models(text: Column) -> Column:
    mapped = lambda c: F.regexp_extract(c["body"], rf"@@map{_GIVEN}", 1)
    return F.transform(_groups(text, _MODEL, "name", "body"), lambda c: _row(c["name"], F.when(mapped(c) != "", mapped(c)).otherwise(c["name"])))


def _python_models(path: Column, text: Column) -> Column:
    classes = F.filter(_groups(text, _CLASS, "name", "head", "body"), lambda c: c["name"] != "")
    django, dirs = text.contains("django"), F.split(path, "/")
    parent = F.lower(F.coalesce(F.when(F.get(dirs, F.size(dirs) - 2) == "models", F.get(dirs, F.size(dirs) - 3)), F.get(dirs, F.size(dirs) - 2), F.lit("")))
    whole = lambda c: F.concat(c["head"], c["body"])
    named = lambda c: whole(c).contains("__tablename__")
    # classes that inherit, directly or through those before them, from a model
    heir = lambda known, c: ~named(c) & (c["head"].contains("models.Model") | (django & (c["head"].contains("Model") | F.exists(known, lambda k: F.contains(c["head"], k)))))
    known = F.aggregate(classes, F.array().cast("array<string>"), lambda known, c: F.when(heir(known, c), F.concat(known, F.array(c["name"]))).otherwise(known))
    abstract = lambda c: F.regexp_replace(whole(c), r"\s+", "").rlike("abstract=True|__abstract__=True")
    own = lambda c: F.regexp_extract(whole(c), rf"__tablename__{_GIVEN}", 1)
    told = lambda c: F.regexp_extract(whole(c), rf"db_table{_GIVEN}", 1)
    table = lambda c: F.when(named(c), own(c)).when(F.array_contains(known, c["name"]), F.when(told(c) != "", told(c)).otherwise(F.concat(parent, F.lit("_"), c["name"]))).otherwise("")
    return F.transform(F.filter(classes, lambda c: ~abstract(c) & (table(c) != "")), lambda c: _row(c["name"], table(c)))


def _script_models(text: Column) -> Column:
    makers = _groups(text, _CREATOR, "name", "before", "after")
    maker = lambda c: F.get(F.filter(makers, lambda m: m["name"] == c["call"]), F.lit(0))
    meant = lambda c: F.when(c["dot"] != "", (c["call"] == "table") & text.contains("Schema(")).otherwise(c["call"].isin(*KITS) | maker(c).isNotNull())
    table = lambda c: F.concat(F.coalesce(maker(c)["before"], F.lit("")), c["table"], F.coalesce(maker(c)["after"], F.lit("")))
    calls = F.filter(_groups(text, _CALL, "bound", "dot", "call", "table"), lambda c: c["call"] != "")
    return F.transform(F.filter(calls, meant), lambda c: _row(c["bound"], table(c)))


def declared_models(sources: DataFrame) -> DataFrame:
    """``path, table, model`` that sources ``path, lang, text`` declare through Prisma, SQLAlchemy, Django or script schema kits; a null text declares none."""
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.col("lang")
    found = F.when(F.col("path").endswith(".prisma"), _schema_models(text)).when(lang == "python", _python_models(F.col("path"), text))
    found = found.when(lang.isin("javascript", "typescript", "tsx"), _script_models(text))
    return sources.select("path", F.inline(found))
