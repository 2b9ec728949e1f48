"""Uses, modules and paths of calls in Rust sources, by patterns on their code; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.definitions import code

_SEEN = r"(?:(pub)(?:\([^)]*\))?\s+)?"
_USE = rf"(?m)^[ \t]*{_SEEN}use\s+([^;]+);"
_MOD = rf"(?m)^[ \t]*{_SEEN}mod\s+(\w+)\s*([;{{])"
_PATHED = r'(?m)^[ \t]*#\[path\s*=\s*"([^"\n]+)"\]\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;'
#: a path before a bracket, behind nothing that would make it a member or a longer name; ``fn`` and ``!`` are no calls
_CALLED = r"(?<![\w.:])(?<!\bfn\s)((?:\w+\s*::\s*)*\w+)\s*(?:::\s*<[^()]*>\s*)?\("


def _groups(text: Column, pattern: str, *names: str) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def use_leaves(tree: Column) -> Column:
    """The paths of a use tree, nested groups written out: one fold over its brackets and commas."""
    tokens = F.regexp_extract_all(F.regexp_replace(tree, r"\s+", " "), F.lit(r"[{},]|[^{},]+"), F.lit(0))
    texts = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).alias("outer"), F.lit("").alias("now"), texts.alias("out"))
    said = lambda s: F.when(s["now"] != "", F.concat(s["out"], F.array(F.concat(F.element_at(s["outer"], -1), s["now"])))).otherwise(s["out"])
    state = lambda outer, now, out: F.struct(outer.alias("outer"), now.alias("now"), out.alias("out"))

    def step(s: Column, token: Column) -> Column:
        opened = state(F.concat(s["outer"], F.array(F.concat(F.element_at(s["outer"], -1), s["now"]))), F.lit(""), s["out"])
        closed = state(F.slice(s["outer"], F.lit(1), F.greatest(F.size(s["outer"]) - 1, F.lit(1))), F.lit(""), said(s))
        return F.when(token == "{", opened).when(token == "}", closed).when(token == ",", state(s["outer"], F.lit(""), said(s))).otherwise(state(s["outer"], F.concat(s["now"], F.trim(token)), s["out"]))

    return said(F.aggregate(tokens, start, step))


def uses(files: DataFrame) -> DataFrame:
    """``path, local, target, public``: names that the code of ``path, lang, text`` takes from paths; ``*`` stands for all of a path."""
    text = code(F.col("text"), F.lit("rust"))
    found = files.where("lang = 'rust'").select("path", F.inline(_groups(text, _USE, "pub", "tree")))
    leaf = found.select("path", (F.col("pub") != "").alias("public"), F.explode(use_leaves(F.col("tree"))).alias("leaf"))
    whole = F.regexp_replace(F.regexp_extract("leaf", r"^(.*?)(?:\s+as\s+(\w+))?$", 1), r"^::|\s", "")
    renamed = F.regexp_extract("leaf", r"\s+as\s+(\w+)$", 1)
    # a::{self} binds a
    target = F.regexp_replace(whole, r"::self$", "")
    local = F.when(renamed != "", renamed).otherwise(F.element_at(F.split(target, "::"), -1))
    return leaf.select("path", local.alias("local"), target.alias("target"), "public").where("local <> '_' and target <> ''").distinct()


def declared_modules(files: DataFrame) -> DataFrame:
    """``path, local, inline, file`` of the modules that sources declare; ``file`` is what a path attribute names, else null."""
    rust = files.where("lang = 'rust'")
    plain = rust.select("path", F.inline(_groups(code(F.col("text"), F.lit("rust")), _MOD, "pub", "local", "end"))).select("path", "local", (F.col("end") == "{").alias("inline"))
    named = rust.select("path", F.inline(_groups(F.coalesce("text", F.lit("")), _PATHED, "file", "local"))).select("path", "local", "file").distinct()
    return plain.distinct().join(named, ["path", "local"], "left")


def called_paths(files: DataFrame) -> DataFrame:
    """``path, line, asked`` of calls by name or path in the code of ``path, lang, text``; members of values are none."""
    lines = files.where("lang = 'rust'").select("path", F.posexplode(F.split(code(F.col("text"), F.lit("rust")), "\n")).alias("i", "text")).where("text rlike '[(]'")
    found = lines.select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(_CALLED), F.lit(1))).alias("asked"))
    return found.select("path", "line", F.regexp_replace("asked", r"\s", "").alias("asked")).where("asked not in ('if', 'while', 'for', 'match', 'return', 'fn', 'in', 'let', 'move', 'Some', 'Ok', 'Err', 'Box')")
