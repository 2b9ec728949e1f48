"""Packages that imports name, by rules of each ecosystem, and the runtimes' own modules."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ecosystems by language; what stays inside a source tree; and the shapes of package names, of which the longest that fits counts.
ECOSYSTEMS = {"javascript": "npm", "typescript": "npm", "tsx": "npm", "python": "pypi", "rust": "cargo", "go": "go"}
INSIDE = {"npm": r"^[./]|^@[^/]*$|^~/|^@/", "pypi": r"^\.", "cargo": r"^(?:crate|self|super)\b|^[^:]*$", "go": "^$"}
SHAPES = {
    "npm": (r"^node:[^/]+", r"^@[^/]+/[^/]+", r"^[^@/]+"),
    "pypi": (r"^[^.]+",),
    "cargo": (r"^[^:]+",),
    "go": (r"^[^/.]+", r"^[^/]*\.[^/]*(?:/[^/]+){0,2}"),
}
# Modules of the runtimes.
NODE = tuple("assert buffer child_process cluster crypto dgram dns events fs http http2 https module net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split())
RUST = ("std", "core", "alloc", "proc_macro", "test")


def ecosystem(lang: Column) -> Column:
    out = F.lit("other")
    for name, eco in ECOSYSTEMS.items():
        out = F.when(lang == name, eco).otherwise(out)
    return out


def package_name(raw: Column, lang: Column) -> Column:
    """The package that an import which no file answers names; null inside the tree, without a name and in other languages."""
    s = F.regexp_replace(F.trim(raw), r"^[\"'`]+|[\"'`]+$", "")
    eco, out = ecosystem(lang), F.lit(None).cast("string")
    for name, shapes in SHAPES.items():
        longest = F.array_max(F.array(*[F.struct(F.length(F.regexp_extract(s, p, 0)).alias("n"), F.trim(F.regexp_extract(s, p, 0)).alias("name")) for p in shapes]))["name"]
        out = F.when((eco == name) & ~s.rlike(INSIDE[name]), longest).otherwise(out)
    return F.when(out.rlike(r"^[A-Za-z0-9_.@/:-]+$"), out)


def runtime_module(eco: Column, name: Column) -> Column:
    """Whether a package is part of its runtime; Python's are those of the Python that runs this."""
    out = F.lit(False)
    tests = {"npm": name.startswith("node:") | name.isin(*NODE), "pypi": name.isin(*sorted(sys.stdlib_module_names)), "cargo": name.isin(*RUST), "go": ~name.contains(".")}
    for key, test in tests.items():
        out = F.when(eco == key, test).otherwise(out)
    return out


def imported_as(eco: Column, name: Column) -> Column:
    """A declared name as code writes it."""
    return F.when(eco == "cargo", F.translate(name, "-", "_")).when(eco == "pypi", F.translate(F.lower(name), "-", "_")).otherwise(name)
