"""Source trees, manifests and patches as rows.

All functions but ``scan_files`` take rows of ``path, text`` (some of ``lang``, too); a null text
gives no rows, other columns are ignored. Only TOML needs Python, on Arrow batches.
"""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: file names and endings of languages
LANGUAGES = {
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
    "php": "php", "blade.php": "blade", "swift": "swift", "scala": "scala", "sh": "bash", "sql": "sql", "md": "markdown", "Dockerfile": "dockerfile", "Makefile": "make",
}

# fixed values: calls that read an environment key, and calls that fetch a path, by language
_QUOTED = r"""\s*["']([A-Za-z0-9_]+)["']"""
_JS = [r"process\.env\.([A-Za-z0-9_]+)", r"process\.env\[" + _QUOTED]
ENV_READS = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS, "python": [rf"os\.(?:environ\[|environ\.get\(|getenv\(){_QUOTED}"],
    "rust": [rf"(?:(?<![:\w])|std::)env::var\({_QUOTED}"], "go": [rf"os\.Getenv\({_QUOTED}"],
}
_FETCH_JS = r"""(?:fetch|axios\.get|axios\.post)\(["'`](/[^"'`]*)["'`]"""
FETCHES = {"javascript": [_FETCH_JS], "typescript": [_FETCH_JS], "tsx": [_FETCH_JS], "python": [r"""requests\.(?:get|post|put|delete)\(["'](/[^"']*)["']"""]}
NPM = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
# fixed values: folders that no scan enters
SKIPPED = (".git", "node_modules", "target", "dist", "build", "vendor", "__pycache__", ".venv", "venv")
# fixed values: what tells Objective-C from MATLAB
OBJC_MARKS = ("@interface", "@implementation", "@protocol", "#import", "#include", "@end")


def scan_files(spark: SparkSession, root: str, most_bytes: int = 1_000_000, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``path`` below ``root`` and ``text`` of its UTF-8 files of at most ``most_bytes``, without the skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    base = root.split(":", 1)[-1].strip("/")
    path = F.regexp_extract("path", rf"(?s)^.*?/\Q{base}\E/(.*)$", 1)
    rows = files.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))) if skipped else rows


def language(path: Column, table: dict[str, str] = LANGUAGES) -> Column:
    """By whole file name, else by the longest ending that is known; null if none is."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    named = F.transform(ends, lambda e: F.coalesce(F.try_element_at(known, e), F.try_element_at(known, F.lower(e))))
    return F.try_element_at(F.filter(named, lambda x: x.isNotNull()), F.lit(1))


def settle(lang: Column, text: Column) -> Column:
    """Languages that share an ending, told apart by the text: ``objc`` and ``matlab``, ``systemverilog`` and ``v``."""
    objc = text.rlike("|".join(OBJC_MARKS))
    verilog = text.contains("endmodule") | (text.contains("module ") & text.contains(");"))
    either = lambda a, b, first: F.when(lang.isin(a, b), F.when(first, a).otherwise(b))
    return F.coalesce(either("objc", "matlab", objc), either("systemverilog", "v", verilog), lang)


def lines(files: DataFrame) -> DataFrame:
    """The columns of ``files`` but its text, with ``line_no`` (from 1) and ``line``."""
    return files.select(*[c for c in files.columns if c != "text"], F.posexplode(F.split("text", r"\r?\n")).alias("_p", "line")).select("*", (F.col("_p") + 1).alias("line_no")).drop("_p")


def _found(files: DataFrame, patterns: dict[str, list[str]], name: str) -> DataFrame:
    by_lang = F.lit(None).cast("array<string>")
    for lang, regexes in patterns.items():
        hits = F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(r), F.lit(1)) for r in regexes]))
        by_lang = F.when(F.col("lang") == lang, hits).otherwise(by_lang)
    rows = lines(files.select("path", "lang", "text")).where(F.col("lang").isin(*patterns))
    return rows.select("path", F.explode(by_lang).alias(name), F.col("line_no").cast("long").alias("line")).distinct()


def env_reads(files: DataFrame) -> DataFrame:
    """``path, key, line`` of environment keys that sources read; ``files`` has ``path, lang, text``."""
    return _found(files, ENV_READS, "key").where(F.length("key") <= 64)


def env_example(files: DataFrame) -> DataFrame:
    """``path, key, line`` of keys that an example file declares."""
    key = F.trim(F.substring_index("line", "=", 1))
    return lines(files.select("path", "text")).select("path", key.alias("key"), F.col("line_no").cast("long").alias("line")).where(F.col("key").rlike("^[A-Za-z0-9_]{1,64}$"))


def fetched_paths(files: DataFrame) -> DataFrame:
    """``path, url, line`` of literal paths that clients fetch; ``files`` has ``path, lang, text``."""
    return _found(files, FETCHES, "url")


@F.pandas_udf(ArrayType(StringType()))
def _toml_names(file: pd.Series, text: pd.Series) -> pd.Series:
    def names(file: str, body: str | None) -> list[str]:
        try:
            top = tomllib.loads(body or "")
        except tomllib.TOMLDecodeError:
            return []
        table = lambda *keys: _table(top, keys)
        if file == "Cargo.toml":
            return [n for k in ("dependencies", "dev-dependencies", "build-dependencies") for n in table(k)]
        listed = table("project").get("dependencies", [])
        return [x for x in listed if isinstance(x, str)] + list(table("tool", "poetry", "dependencies"))

    return pd.Series([names(f, b) for f, b in zip(file, text, strict=True)])


def _table(top: dict, keys: tuple[str, ...]) -> dict:
    for k in keys:
        top = top.get(k, {}) if isinstance(top, dict) else {}
    return top if isinstance(top, dict) else {}


def manifest_deps(files: DataFrame) -> DataFrame:
    """``path, name, ecosystem, from_lock`` of declared dependencies, repeats kept.

    A name ends at the first character that is no letter, digit, ``-``, ``_`` or ``.``, so versions go,
    and so do names that begin otherwise; ``python`` itself is none. Go modules keep three parts.
    What can't be parsed declares nothing.
    """
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "text")
    text, plain = F.col("text"), F.col("file").rlike(r"^requirements.*\.txt$")

    def part(which: Column, names: Column, ecosystem: str, lock: bool = False) -> DataFrame:
        return rows.where(which).select("path", F.explode(names).alias("name"), F.lit(ecosystem).alias("ecosystem"), F.lit(lock).alias("from_lock"))

    npm = [F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), F.array().cast("array<string>")) for k in NPM]
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^\s*require \((.*?)^\s*\)"), F.lit(1))
    listed = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^\s*([^\s/]\S*)"), F.lit(1))))
    single = F.regexp_extract_all(text, F.lit(r"(?m)^\s*require\s+([^\s(]\S*)"), F.lit(1))
    named = (
        part(F.col("file") == "package.json", F.flatten(F.array(*npm)), "npm")
        .unionByName(part(F.col("file") == "Cargo.toml", _toml_names("file", "text"), "cargo"))
        .unionByName(part(F.col("file") == "pyproject.toml", _toml_names("file", "text"), "pypi"))
        .unionByName(part(F.col("file") == "Cargo.lock", F.regexp_extract_all(text, F.lit(r'(?m)^\s*name = "([^"]+)"\s*$'), F.lit(1)), "cargo", True))
        .unionByName(part(plain, F.regexp_extract_all(text, F.lit(r"(?m)^\s*([^\s#-].*)$"), F.lit(1)), "pypi"))
    )
    named = named.withColumn("name", F.regexp_extract("name", r'^\s*"?([\p{L}\p{N}_.-]+)', 1)).where("name not in ('', 'python')")
    go = part(F.col("file") == "go.mod", F.concat(listed, single), "go")
    return named.unionByName(go.withColumn("name", F.substring_index("name", "/", 3)))


def changed_ranges(patches: DataFrame) -> DataFrame:
    """``patch, path, first, last``: the lines of the new side that each hunk of a patch without context covers.

    ``patches`` has ``patch, text``. A hunk that only removes covers the line before it. Patches are cut
    into files by a split, so no order of rows is needed.
    """
    sections = patches.select("patch", F.explode(F.split("text", r"(?m)^diff --git ")).alias("part"))
    hunks = sections.select("patch", F.regexp_extract("part", r"(?m)^\+\+\+ b/(.*)$", 1).alias("path"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^@@ \S+ \+(\d+(?:,\d+)?)"), F.lit(1))).alias("at"))
    first = F.substring_index("at", ",", 1).cast("long")
    length = F.when(F.col("at").contains(","), F.substring_index("at", ",", -1).cast("long")).otherwise(1)
    return hunks.where("path <> ''").select("patch", "path", first.alias("first"), (first + F.greatest(length, F.lit(1)) - 1).alias("last"))


def numstat(patches: DataFrame, private: tuple[str, ...] = ()) -> DataFrame:
    """``patch, paths, added, removed`` from ``patch, text`` of added, removed and path between tabs; binary files count 0."""
    cols = F.split("line", "\t")
    rows = patches.select("patch", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.size(cols) >= 3)
    rows = rows.select("patch", F.coalesce(cols[0].try_cast("long"), F.lit(0)).alias("a"), F.coalesce(cols[1].try_cast("long"), F.lit(0)).alias("r"), cols[2].alias("path"))
    for folder in private:
        rows = rows.where(~F.col("path").startswith(folder.rstrip("/") + "/"))
    return rows.groupBy("patch").agg(F.count(F.lit(1)).alias("paths"), F.sum("a").alias("added"), F.sum("r").alias("removed"))


# Where manifests declare programs, and where their files may lie.
_BIN = r"(?ms)^\[\[bin\]\][^\n]*\n(.*?)(?=^\[|\z)"
_SCRIPTS = r"(?ms)^\[(?:project|tool\.poetry)\.scripts\][^\n]*\n(.*?)(?=^\[|\z)"
_PAIR = r"(?m)^\s*[\"']?([\w.-]+)[\"']?\s*=\s*[\"']([^\"'\n]+)[\"']"
PLACES = ("{}.py", "src/{}.py", "{}/__init__.py", "src/{}/__init__.py")


def declared_entries(files: DataFrame) -> DataFrame:
    """``symbol, file`` of the programs that Cargo.toml and pyproject.toml among ``path, text`` declare, each once.

    A program of Cargo without a path is ``src/bin/<name>.rs`` beside its manifest. A script of Python is a function of the first file of :data:`PLACES` that there
    is; if there is none, the manifest stands for it.
    """
    text, folder = F.coalesce(F.col("text"), F.lit("")), F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    value = lambda part, name: F.regexp_extract(part, rf"(?m)^\s*{name}\s*=\s*[\"']([^\"'\n]+)[\"']", 1)
    bins = files.where(r"path rlike '(^|/)Cargo\\.toml$'").select(folder.alias("folder"), F.explode(F.regexp_extract_all(text, F.lit(_BIN), F.lit(1))).alias("part"))
    bins = bins.select("folder", value(F.col("part"), "name").alias("symbol"), value(F.col("part"), "path").alias("at")).where("symbol <> ''")
    bins = bins.select("symbol", F.concat("folder", F.when(F.col("at") != "", F.col("at")).otherwise(F.concat(F.lit("src/bin/"), "symbol", F.lit(".rs")))).alias("file"))
    parts = files.where(r"path rlike '(^|/)pyproject\\.toml$'").select("path", folder.alias("folder"), F.explode(F.regexp_extract_all(text, F.lit(_SCRIPTS), F.lit(1))).alias("part"))
    pairs = F.arrays_zip(*[F.regexp_extract_all("part", F.lit(_PAIR), F.lit(k + 1)).alias(n) for k, n in enumerate(("script", "target"))])
    scripts = parts.select("path", "folder", F.inline(pairs))
    module, function = F.trim(F.substring_index("target", ":", 1)), F.regexp_extract("target", r"^[^:]*:(.*)$", 1)
    symbol = F.trim(F.when(F.col("target").contains(":"), function).otherwise(F.col("script")))
    places = F.array(*[F.concat(F.col("folder"), F.lit(place.partition("{}")[0]), F.translate(module, ".", "/"), F.lit(place.partition("{}")[2])) for place in PLACES])
    asked = scripts.select("path", symbol.alias("symbol"), F.posexplode(places).alias("rank", "file")).distinct()
    there = asked.join(files.select(F.col("path").alias("file")).distinct(), "file").groupBy("path", "symbol").agg(F.min_by("file", "rank").alias("file"))
    found = asked.select("path", "symbol").distinct().join(there, ["path", "symbol"], "left").select("symbol", F.coalesce("file", "path").alias("file"))
    return bins.union(found).distinct()
