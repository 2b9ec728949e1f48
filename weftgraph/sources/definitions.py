"""Definitions, calls and imports of sources, by lines and indentation; there is no grammar here.

Comments, quoted texts and markup are blanked first, byte for byte, so lines and places stay those of the file.
A definition ends before the next line that isn't indented deeper, or with the bracket that closes it there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.flowmap import indent

SCRIPTS = ("javascript", "typescript", "tsx", "vue", "svelte", "astro")
#: languages whose code stands in parts of a page
EMBEDDED = ("vue", "svelte", "astro")
# What comments and quoted texts look like in each style.
_QUOTED = r"'(?:[^'\\\n]|\\.)*+(?:'|$)|\"(?:[^\"\\\n]|\\.)*+(?:\"|$)"
HIDDEN = {
    "python": rf"#[^\n]*|\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)|{_QUOTED}",
    "script": rf"//[^\n]*|/\*.*?(?:\*/|\z)|`(?:[^`\\]|\\.)*+(?:`|\z)|{_QUOTED}",
    # a quote in Rust may begin a lifetime, so only whole characters are texts
    "brace": r"//[^\n]*|/\*.*?(?:\*/|\z)|`[^`]*(?:`|\z)|'(?:[^'\\\n]|\\.[^'\n]{0,8})'|\"(?:[^\"\\]|\\.)*+(?:\"|\z)",
    "sql": r"--[^\n]*|/\*.*?(?:\*/|\z)|'[^'\n]*(?:'|$)",
}
# First words of definitions, by style; the name is the last group.
_MODIFIERS = r"(?:(?:pub(?:\([^)]*\))?|export|default|declare|public|private|protected|static|abstract|async|unsafe|const|extern|readonly|override)\s+)*"
DEFINED = {
    "python": (("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")),
    "script": (
        ("function", rf"^\s*{_MODIFIERS}function\s*\*?\s*([\w$]+)"), ("class", rf"^\s*{_MODIFIERS}class\s+([\w$]+)"), ("interface", rf"^\s*{_MODIFIERS}interface\s+([\w$]+)"),
        ("function", rf"^\s*{_MODIFIERS}(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]*)?=>|[\w$]+\s*=>)"),
        ("function", r"^\s*(?:export\s+)?([\w$]+)\s*=\s*(?:async\s*)?\([^()]*\)\s*=>"),
        ("method", rf"^\s+{_MODIFIERS}(?:get\s+|set\s+)?\*?(?!(?:if|for|while|switch|catch|return|function|new|else|do|with|await|typeof|constructor\b(?!\())\b)([\w$]+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{]*)?\{{\s*\}}?\s*$"),
    ),
    "rust": (
        ("function", rf"^\s*{_MODIFIERS}(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)"), ("class", rf"^\s*{_MODIFIERS}(?:struct|enum|union)\s+(\w+)"), ("interface", rf"^\s*{_MODIFIERS}trait\s+(\w+)"),
        ("impl", r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?:\w+::)*(\w+)"), ("module", rf"^\s*{_MODIFIERS}mod\s+(\w+)\s*\{{"),
    ),
    "go": (("function", r"^func\s+(\w+)"), ("method", r"^func\s*\([^)]*\)\s*(\w+)"), ("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")),
}
# Words before a bracket that are no calls.
NO_CALLS = tuple("if for while switch match catch return function def class fn func elif and or not in new await async with except print_ lambda yield del assert raise else do typeof super".split())
IMPORTED = {
    "python": r"(?m)^[ \t]*(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([\w.]+))",
    "script": r"(?m)(?:^[ \t]*(?:import|export)\b[^'\"`;]*?(?:\bfrom\b)?\s*['\"]([^'\"\n]+)['\"]|\b(?:require|import)\(\s*['\"]([^'\"\n]+)['\"])",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t]+([^;]+);|mod[ \t]+(\w+);)",
    "go": r"(?m)(?:^import[ \t]+(?:[\w.]+[ \t]+)?\"([^\"\n]+)\"|^[ \t]+(?:[\w.]+[ \t]+)?\"([^\"\n]+)\"[ \t]*$)",
}


def blank(text: Column) -> Column:
    """As many blanks as a text has bytes; line ends stay."""
    out = F.regexp_replace(text, r"[\x00-\x7F&&[^\n]]", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\x{80}-\x{7FF}]", "  "), r"[\x{800}-\x{FFFF}]", "   "), r"[\x{10000}-\x{10FFFF}]", "    ")


def _parts(text: Column, pattern: str) -> Column:
    """A text as structs ``whole, found`` of what a pattern finds and the single characters and runs between."""
    # the pattern's first characters end a run; all else goes by itself
    either = rf"(?sm)({pattern})|[^#'\"`/\-]+|."
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(either), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(either), F.lit(1)).alias("found"))


def masked(text: Column, style: str) -> Column:
    """A text with comments and quoted texts blanked, byte for byte. ``style`` is a key of ``HIDDEN``."""
    return F.array_join(F.transform(_parts(F.coalesce(text, F.lit("")), HIDDEN[style]), lambda p: F.when(p["found"] != "", blank(p["found"])).otherwise(p["whole"])), "")


def script_parts(text: Column, lang: Column) -> Column:
    """A page with all but its scripts blanked; of Astro the part between the first two ``---`` counts too. Other languages stay as they are."""
    def kept(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*>(?:(?!</script).)*+|[^<]+|<"), F.lit(0))
        head = lambda t: F.regexp_extract(t, r"(?is)^(<script[^>]*>)", 1)
        return F.array_join(F.transform(found, lambda t: F.when(head(t) != "", F.concat(blank(head(t)), F.substr(t, F.length(head(t)) + 1))).otherwise(blank(t))), "")

    whole = F.coalesce(text, F.lit(""))
    front = F.regexp_extract(whole, r"(?s)^(\s*---.*?(?:\n(?=---)|\z))", 1)
    fenced = F.concat(F.regexp_replace(front, r"^(\s*)---", "$1   "), kept(F.substr(whole, F.length(front) + 1)))
    return F.when(~lang.isin(*EMBEDDED), whole).when((lang == "astro") & (front != ""), fenced).otherwise(kept(whole))


def _style(lang: Column) -> Column:
    return F.when(lang.isin(*SCRIPTS), "script").otherwise(lang)


def code(text: Column, lang: Column) -> Column:
    """A text without markup, comments and quoted texts, each blanked."""
    plain = script_parts(text, lang)
    return F.when(lang == "python", masked(plain, "python")).when(lang.isin(*SCRIPTS), masked(plain, "script")).otherwise(masked(plain, "brace"))


def _defined(line: Column, lang: Column) -> Column:
    """``struct(kind, name)`` of what a line defines; null if nothing."""
    style, out = _style(lang), F.lit(None).cast("struct<kind:string,name:string>")
    for name, patterns in DEFINED.items():
        for kind, pattern in reversed(patterns):
            found = F.regexp_extract(line, pattern, 1)
            out = F.when((style == name) & (found != ""), F.struct(F.lit(kind).alias("kind"), found.alias("name"))).otherwise(out)
    return out


#: what a line must begin with so that it doesn't end the definition before it: brackets that close its head or open its body
GOES_ON = (")", "{")


def _extents(marks: list[dict]) -> Iterator[tuple[dict, int, dict | None]]:
    """Each definition among a file's lines with its last line and the definition around it, in one pass.

    Open definitions form a stack, each indented deeper than the one below. A line ends those that it isn't deeper
    than, so every line is pushed and popped once; a definition's owner lies under it when it is pushed.
    """
    stack: list[tuple[dict, dict | None]] = []
    before = None

    def ended(stop: dict | None) -> Iterator[tuple[dict, int, dict | None]]:
        while stack and (stop is None or stack[-1][0]["at"] >= stop["at"]):
            own, owner = stack.pop()
            closed = stop is not None and stop["mark"] == "}"
            yield own, stop["i"] if closed else before["i"], owner

    for m in marks:
        if m["mark"] not in GOES_ON:
            yield from ended(m)
        if m["name"] is not None:
            stack.append((m, stack[-1][0] if stack else None))
        before = m
    yield from ended(None)


CLASSES = ("class", "interface", "impl")
_FOUND = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("body", pa.string())])
_SCOPED = pa.schema([("path", pa.string()), ("line", pa.int32()), ("scope", pa.int32()), ("name", pa.string()), ("owner", pa.string()), ("chain", pa.list_(pa.int32()))])


def _found(path: str, lines: list[str], marks: list[dict]) -> Iterator[dict]:
    """The definitions of a file, by their first lines."""
    for own, last, up in sorted(_extents(marks), key=lambda f: f[0]["i"]):
        kind = "method" if own["kind"] == "function" and up and up["kind"] in CLASSES else own["kind"]
        yield {"path": path, "kind": kind, "name": own["name"], "owner": up and up["name"], "first": own["i"], "last": last, "body": "\n".join(lines[own["i"] - 1 : last])}


def _scoped(path: str, lines: list[str], marks: list[dict]) -> Iterator[dict]:
    """The innermost definition around each line of a file that isn't blank; lines without code go with the one before."""
    starts, coded, stack = {own["i"]: (own, last) for own, last, _ in _extents(marks)}, {m["i"] for m in marks}, []
    for i, text in enumerate(lines, 1):
        while i in coded and stack and stack[-1][1] < i:
            stack.pop()
        if i in starts:
            stack.append(starts[i])
        if not text.strip():
            continue
        # names bound in a class's body are not seen from its methods
        chain = [own["i"] for k, (own, _) in enumerate(reversed(stack)) if k == 0 or own["kind"] not in CLASSES]
        owner = next((own["name"] for own, _ in reversed(stack) if own["kind"] in CLASSES), None)
        yield {"path": path, "line": i, "scope": chain[0] if chain else 0, "name": stack[-1][0]["name"] if stack else None, "owner": owner, "chain": [*chain, 0]}


def _by_file(files: DataFrame, rows: Callable[[str, list[str], list[dict]], Iterator[dict]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """What ``rows(path, lines, marks)`` gives for each file; marks are the lines that aren't blank, with indentation and definition."""
    lines = F.split(code(F.col("text"), F.col("lang")), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("i"), indent(line).alias("at"), F.regexp_extract(line, r"^\s*(\S?)", 1).alias("mark"), _defined(line, F.col("lang")).alias("d")))
    marks = F.transform(F.filter(numbered, lambda x: x["mark"] != ""), lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at"), x["mark"].alias("mark"), x["d"]["kind"].alias("kind"), x["d"]["name"].alias("name")))
    whole = files.select("path", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), marks.alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one by one: of a batch of large files one is held as objects
                yield pa.RecordBatch.from_pylist(list(rows(*(c[k].as_py() for c in batch.columns))), schema)

    return whole.mapInArrow(run, spark_schema)


def definitions(files: DataFrame) -> DataFrame:
    """``path, kind, name, owner, first, last, body`` of what ``path, lang, text`` define; lines count from 1.

    ``owner`` is the innermost definition around it; functions of a class, interface or impl are methods. A null text
    defines nothing. A definition lasts to the next line that is indented no deeper, and its closing bracket. Each file is one row
    throughout and its lines are gone through once, so the work grows with the text, not with the definitions.
    """
    return _by_file(files, _found, _FOUND, "path string, kind string, name string, owner string, first int, last int, body string")


def line_scopes(files: DataFrame) -> DataFrame:
    """``path, line, scope, name, owner, chain`` of each line of ``path, lang, text`` that isn't blank.

    ``scope`` is the first line of the innermost definition around it, 0 for none, ``name`` what it defines, ``chain`` that line, those of the
    definitions around it outwards but for classes, whose names methods don't see, and 0; ``owner`` is the innermost class, interface or impl. A definition's first line is its own;
    comments and lines of quoted texts go with the code before them.
    """
    return _by_file(files, _scoped, _SCOPED, "path string, line int, scope int, name string, owner string, chain array<int>")


def call_names(files: DataFrame) -> DataFrame:
    """``path, line, receiver, name`` of the calls that the code of ``path, lang, text`` makes; definitions are none. The receiver of a member of what a call gives is ``()``."""
    lines = files.select("path", "lang", F.posexplode(F.split(code(F.col("text"), F.col("lang")), "\n")).alias("i", "line")).where("line rlike '[(]'")
    # lists of declarations in Go
    lines = lines.where((F.col("lang") != "go") | ~F.col("line").rlike(r"^\s*(?:import|const|var|type)\s*\("))
    line = F.when(_defined(F.col("line"), F.col("lang")).isNotNull(), F.regexp_replace("line", r"^(\s*(?:\w+\s+)*(?:\([^)]*\)\s*)?)[\w$]+\s*(?:<[^>]*>)?\(", "$1")).otherwise(F.col("line"))
    pattern = F.lit(r"(?:(?<![\w$.:])|(?<=[)\]])(\.|::))(?:([\w$]+(?:(?:\.|::)[\w$]+)*)(?:\.|::))?([\w$]+)\s*!?\(")
    calls = F.arrays_zip(*[F.regexp_extract_all(line, pattern, F.lit(k + 1)).alias(n) for k, n in enumerate(("member", "receiver", "name"))])
    found = lines.select("path", (F.col("i") + 1).alias("line"), F.inline(calls))
    return found.where(~F.col("name").isin(*NO_CALLS)).select("path", "line", F.when(F.col("member") != "", F.concat_ws(".", F.lit("()"), F.nullif("receiver", F.lit("")))).otherwise(F.nullif("receiver", F.lit(""))).alias("receiver"), "name")


def imports(files: DataFrame) -> DataFrame:
    """``path, lang, raw``: what each file imports, each once."""
    text, lang = script_parts(F.col("text"), F.col("lang")), _style(F.col("lang"))
    found = F.array().cast("array<string>")
    for name, pattern in IMPORTED.items():
        both = F.zip_with(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2)], lambda a, b: F.concat(a, b))
        found = F.when(lang == name, both).otherwise(found)
    return files.select("path", "lang", F.explode(F.array_distinct(F.filter(found, lambda r: r != ""))).alias("raw"))
