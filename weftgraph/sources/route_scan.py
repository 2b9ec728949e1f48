"""HTTP routes that sources declare, found by patterns on whole texts; no parser, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Methods of routers, in the order in which they are looked for.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "all")
HTTP = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
_PATH = r"""(?:"(/[^"]*)"|'(/[^']*)')"""
_NAME = r"[\p{L}\p{N}_.:]"
#: receiver.method("/path", handler); a call in place of the handler is none
JS = rf"\.({'|'.join(METHODS)})\(\s*{_PATH}[\s,]*({_NAME}++)(?!\s*\()"
GO = rf"\.(HandleFunc|Handle|{'|'.join(HTTP)})\(\s*{_PATH}[\s,]*({_NAME}++)(?!\s*\()(?=([^\n]*))"
RUST = rf"\.route\(\s*{_PATH}\s*,((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"
#: a decorator with a path; the def that follows other decorators
PYTHON = rf"(?m)^[ \t]*@([^\n(]*)\(\s*{_PATH}([^\n]*)(?:(?=\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async )?def (\w+)))?"


def _hits(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs ``1``, ``2`` ... of a pattern's groups; those that took no part are empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(str(k)) for k in range(1, groups + 1)])


def _hit(method: Column, url: Column, handler: Column) -> Column:
    return F.struct(method.alias("method"), url.alias("url"), F.when(handler != "", handler).alias("handler"))


def _js(text: Column) -> Column:
    hits = F.filter(_hits(text, JS, 4), lambda h: h["4"] != "async")
    return F.transform(hits, lambda h: _hit(F.upper(h["1"]), F.concat(h["2"], h["3"]), h["4"]))


def _go(text: Column) -> Column:
    hits = F.filter(_hits(text, GO, 5), lambda h: h["4"] != "nil")
    chained = lambda h: F.upper(F.regexp_extract(h["5"], r"""\.Methods\(\s*["']([^"']*)""", 1))
    method = lambda h: F.when(~h["1"].startswith("Handle"), h["1"]).when(chained(h) != "", chained(h)).otherwise("ANY")
    return F.transform(hits, lambda h: _hit(method(h), F.concat(h["2"], h["3"]), h["4"]))


def _rust(text: Column) -> Column:
    def first(arg: Column) -> Column:
        found = [F.struct(F.lit(m.upper()).alias("m"), F.regexp_extract(arg, rf"{m}\([\s,]*({_NAME}+)", 1).alias("h")) for m in METHODS[:-1]]
        return F.try_element_at(F.filter(F.array(*found), lambda x: x["h"] != ""), F.lit(1))

    hits = F.transform(_hits(text, RUST, 3), lambda h: F.struct(F.concat(h["1"], h["2"]).alias("url"), first(h["3"]).alias("x")))
    return F.transform(F.filter(hits, lambda h: h["x"].isNotNull()), lambda h: _hit(h["x"]["m"], h["url"], F.regexp_extract(h["x"]["h"], r"([^.:]*)$", 1)))


def _python(text: Column) -> Column:
    def methods(h: Column) -> Column:
        listed = F.regexp_extract(h["4"], r"\[([^\]]*)\]", 1)
        names = F.filter(F.transform(F.split(listed, ","), lambda m: F.upper(F.regexp_replace(F.trim(m), "[\"']", ""))), lambda m: m != "")
        one = F.regexp_extract(h["1"], rf"\.({'|'.join(METHODS)})$", 1)
        return F.when(h["1"].endswith(".route"), F.when(h["4"].contains("["), names).otherwise(F.array(F.lit("GET")))).when(one != "", F.array(F.upper(one))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(_hits(text, PYTHON, 5), lambda h: F.transform(methods(h), lambda m: _hit(m, F.concat(h["2"], h["3"]), h["5"]))))


def file_route(path: Column) -> Column:
    """The url of a file whose place is its route; null for others. ``[id]`` is a parameter, ``[...x]`` all that follows."""
    pages = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"pages/api/(.*)$", 1), r"(\.tsx|\.ts|\.js)$", ""), r"(^|/)index$", "")
    app = F.regexp_extract(path, r"app/(.*)/route\.(?:tsx|ts|js)$", 1)
    route = F.when(path.contains("pages/api/"), F.concat(F.lit("api/"), pages)).when(path.rlike(r"app/.*route\.(tsx|ts|js)$"), app)
    part = lambda s: F.when(~s.startswith("["), s).when(s.contains("..."), "*").otherwise(F.concat(F.lit(":"), F.regexp_replace(s, r"^[\[\]]+|[\[\]]+$", "")))
    return F.when(route.isNotNull(), F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(route, "/"), lambda s: s != ""), part), "/")))


def _exported(text: Column, url: Column) -> Column:
    found = [F.when(text.rlike(rf"export (?:async function|function|const) {m}"), _hit(F.lit(m), url, F.lit(m))) for m in HTTP]
    return F.when(url.isNotNull(), F.filter(F.array(*found), lambda h: h.isNotNull())).otherwise(F.array().cast("array<struct<method:string,url:string,handler:string>>"))


def routes(files: DataFrame) -> DataFrame:
    """``path, method, url, handler`` of the routes that ``path, lang, text`` declare, each once; a null text declares none."""
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.col("lang")
    script = lang.isin("javascript", "typescript", "tsx")
    found = F.when(script, F.concat(_js(text), _exported(text, file_route(F.col("path"))))).when(lang == "python", _python(text)).when(lang == "rust", _rust(text)).when(lang == "go", _go(text))
    return files.select("path", F.inline(found)).distinct()
