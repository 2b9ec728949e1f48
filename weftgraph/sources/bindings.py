"""Names that sources bind: by imports, and to types, found by patterns on their code; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.definitions import SCRIPTS, code

_FROM = r"(?ms)^[ \t]*(?:import|export)\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s*as\s+([\w$]+)\s*)?(?:\{([^}]*)\}\s*)?from\s*['\"]([^'\"\n]+)['\"]"
_PY_FROM = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#(]+))"
_PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?"
# How each language binds a local, the name first, then its type where the text tells it.
_TYPE = r"([A-Za-z_]\w*(?:\.\w+)*)"
BOUND = {
    "script": (rf"\b(?:const|let|var)\s+([\w$]+)\s*(?::\s*{_TYPE}\s*)?(?:=\s*(?:new\s+{_TYPE})?|;|$)", rf"(?:function\b[^(]*|^\s+[\w$]+\s*)?[(,]\s*([\w$]+)\s*\??\s*:\s*{_TYPE}()"),
    "python": (rf"^\s*([A-Za-z_]\w*)\s*(?::\s*{_TYPE}\s*)?=(?!=)\s*(?:((?:\w+\.)*[A-Z]\w*)\s*\()?", rf"^\s*(?:async\s+)?def\s.*?[(,]\s*([A-Za-z_]\w*)\s*:\s*{_TYPE}()"),
    "rust": (r"\blet\s+(?:mut\s+)?(\w+)\s*(?::\s*&?\s*(?:mut\s+)?([\w:]+)[^=;]*)?(?:=\s*((?:\w+::)*[A-Z]\w*)::(?:new|default|new_\w+)\s*\()?", r"[(,]\s*(?:mut\s+)?([a-z_]\w*)\s*:\s*&?\s*(?:'\w+\s+)?(?:mut\s+)?([A-Z]\w*)()"),
    "go": (r"\b(\w+)\s*:=\s*()(?:&?([A-Z]\w*)\s*\{)?", r"[(,]\s*([a-z_]\w*)\s+\*?([A-Z]\w*)()"),
}


def _groups(text: Column, pattern: str, *names: str) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def _listed(names: Column) -> Column:
    """``struct<local, exported>`` of each of ``a, b as c``."""
    each = F.filter(F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, "^type ", "")
    return F.transform(each, lambda x: F.struct(F.regexp_extract(bare(x), r"(\S+)$", 1).alias("local"), F.regexp_extract(bare(x), r"^(\S+)", 1).alias("exported")))


def named_imports(files: DataFrame) -> DataFrame:
    """``path, lang, raw, local, exported`` of the names that Python and scripts take from modules; no ``exported`` binds the module itself."""
    text = F.coalesce(F.col("text"), F.lit(""))
    script = files.where(F.col("lang").isin(*SCRIPTS)).select("path", "lang", F.inline(_groups(text, _FROM, "one", "all", "some", "raw")))
    whole = F.struct(F.col("all").alias("local"), F.lit(None).cast("string").alias("exported"))
    one = F.struct(F.col("one").alias("local"), F.lit("default").alias("exported"))
    script = script.select("path", "lang", "raw", F.inline(F.filter(F.concat(F.array(whole, one), _listed(F.col("some"))), lambda x: ~x["local"].isin("", "*"))))
    python = files.where("lang = 'python'")
    names = python.select("path", "lang", F.inline(_groups(text, _PY_FROM, "raw", "in", "plain")))
    names = names.select("path", "lang", "raw", F.inline(F.filter(_listed(F.concat("in", "plain")), lambda x: x["local"] != "*")))
    modules = python.select("path", "lang", F.inline(_groups(text, _PY_IMPORT, "raw", "as")))
    modules = modules.select("path", "lang", "raw", F.when(F.col("as") != "", F.col("as")).otherwise(F.col("raw")).alias("local"), F.lit(None).cast("string"))
    return script.union(names).union(modules).distinct()


def bound_locals(files: DataFrame) -> DataFrame:
    """``path, line, local, type`` of what the code of ``path, lang, text`` binds on each line; a null type binds without telling one.

    Variables count with and without type, parameters with a type only.
    """
    style = F.when(F.col("lang").isin(*SCRIPTS), "script").otherwise(F.col("lang"))
    lines = files.where(F.col("lang").isin(*SCRIPTS, "python", "rust", "go")).select("path", style.alias("style"), F.posexplode(F.split(code(F.col("text"), F.col("lang")), "\n")).alias("i", "text"))
    found = F.array().cast("array<struct<local:string,told:string,made:string>>")
    for name, patterns in BOUND.items():
        found = F.when(F.col("style") == name, F.concat(*[_groups(F.col("text"), p, "local", "told", "made") for p in patterns])).otherwise(found)
    rows = lines.select("path", (F.col("i") + 1).alias("line"), F.inline(found))
    last = F.regexp_extract(F.when(F.col("told") != "", F.col("told")).otherwise(F.col("made")), r"(\w+)$", 1)
    return rows.select("path", "line", "local", F.when(last != "", last).alias("type")).distinct()
