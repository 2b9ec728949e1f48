"""Imports, structured calls, plans, areas and declared tables on literal cases and against plain code."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import planning, resolution
from weftgraph.sources import table_scan

FILES = ["web/a.ts", "web/lib/index.ts", "web/b.ts", "py/app/__init__.py", "py/app/core.py", "py/app/sub/x.py", "py/util.py", "lib/util.py",
         "c1/src/a/mod.rs", "c1/src/a/b.rs", "c1/src/lib.rs", "c2/src/a/b.rs", "c2/tests/only.rs", "c1/tests/help.rs", "go/x/a.go", "go/x/b.go", "go/m.go", "kt/math/Max.kt"]
IMPORTS = [
    ("web/b.ts", "typescript", "'./a'", {("web/a.ts", 2)}),
    ("web/b.ts", "tsx", "./lib", {("web/lib/index.ts", 2)}),
    ("web/lib/index.ts", "javascript", "../b", {("web/b.ts", 2)}),
    ("web/b.ts", "typescript", "react", set()),
    ("py/app/sub/x.py", "python", "..core", {("py/app/core.py", 2)}),
    ("py/app/sub/x.py", "python", "..", {("py/app/__init__.py", 2)}),
    ("py/util.py", "python", "app.core", {("py/app/core.py", 1)}),
    ("py/util.py", "python", "core", {("py/app/core.py", 0)}),
    ("py/app/core.py", "python", "util", {("py/util.py", 0), ("lib/util.py", 0)}),
    ("py/util.py", "python", "app", {("py/app/__init__.py", 1)}),
    ("c1/src/lib.rs", "rust", "a", {("c1/src/a/mod.rs", 2)}),
    ("c1/src/lib.rs", "rust", "crate::a::b::{C, D}", {("c1/src/a/b.rs", 1)}),
    ("c2/src/z.rs", "rust", "a::b::C", {("c2/src/a/b.rs", 1)}),
    ("c3/src/z.rs", "rust", "a::b", {("c1/src/a/b.rs", 0), ("c2/src/a/b.rs", 0)}),
    ("c3/src/z.rs", "rust", "only::x", set()),
    ("c3/src/z.rs", "rust", "crate::a::b", set()),
    ("go/m.go", "go", "host/m/go/x", {("go/x/a.go", 2), ("go/x/b.go", 2)}),
    ("go/m.go", "go", "fmt", set()),
    ("kt/a.kt", "kotlin", "math.Max.of", {("kt/math/Max.kt", 1)}),
    ("kt/a.kt", "java", "math.Max", set()),
    ("kt/a.kt", "kotlin", "", set()),
]


def test_imports(spark):
    rows = [(n, path, lang, raw) for n, (path, lang, raw, _) in enumerate(IMPORTS)]
    imports = spark.createDataFrame(rows, "site int, path string, lang string, raw string")
    files = spark.createDataFrame([(f,) for f in [*FILES, FILES[0]]], "path string")
    got = {n: set() for n in range(len(IMPORTS))}
    for r in resolution.import_files(imports, files, "host/m").collect():
        got[r.site].add((r.target, r.tier))
    assert got == {n: want for n, (_, _, _, want) in enumerate(IMPORTS)}
    assert resolution.import_files(imports.where("false"), files).count() == 0


def test_structured_calls(spark):
    defs = spark.createDataFrame(
        [("K", "k.py", "Klass", None), ("K.m", "k.py", "m", "K"), ("B", "b.py", "Base", None), ("B.base", "b.py", "base", "B"), ("f", "u.py", "f", None), ("g1", "u.py", "g", None), ("g2", "u.py", "g", None), ("K.t", "k.py", "t", "K"), ("K.t2", "k.py", "t", "K")],
        "id string, path string, name string, owner string",
    )
    again = spark.createDataFrame([("pkg", "f", "mid", "f"), ("mid", "f", "u.py", "f"), ("r1", "x", "r2", "x"), ("r2", "x", "r1", "x")], "path string, name string, target string, exported string")
    bindings = spark.createDataFrame([("a.py", "f", "pkg", "f"), ("a.py", "u", "u.py", None), ("a.py", "Kl", "k.py", "Klass"), ("a.py", "x", "r1", "x"), ("a.py", "g", "u.py", "g")], "path string, local string, target string, exported string")
    bases = spark.createDataFrame([("K", "B"), ("B", "K")], "owner string, base string")
    types = spark.createDataFrame([("a.py", 7, "v", "Kl")], "path string, scope int, local string, type string")
    calls = spark.createDataFrame(
        [(1, "k.py", 0, "K", "self", "base"), (2, "a.py", 0, None, None, "f"), (3, "a.py", 0, None, "u", "f"), (4, "a.py", 7, None, "v", "m"), (5, "a.py", 8, None, "v", "m"), (6, "a.py", 0, None, "Kl", "base"),
         (7, "a.py", 0, None, None, "x"), (8, "a.py", 0, None, "u", "g"), (9, "k.py", 0, "K", "self", "t"), (10, "k.py", 0, None, "Klass", "m"), (11, "a.py", 0, None, None, "g")],
        "site int, path string, scope int, owner string, receiver string, name string",
    )
    got = {r.site: (r.id, r.rule) for r in resolution.structured_calls(calls, defs, bindings, bases, types, again).collect()}
    assert got == {1: ("B.base", 1), 2: ("f", 2), 3: ("f", 3), 4: ("K.m", 4), 6: ("B.base", 5), 10: ("K.m", 5)}
    named = spark.createDataFrame([(1, "no", 1.0, 1), (5, "K.m", 0.5, 0), (7, "y", 1.0, 1)], "site int, id string, weight double, tier int")
    soft = spark.createDataFrame([(2, "no"), (5, "z")], "site int, id string")
    hard = spark.createDataFrame([(1, "B.base"), (2, "f")], "site int, id string")
    assert sorted((r.site, r.id, r.tier) for r in resolution.merged_calls(hard, soft, named).collect()) == [(1, "B.base", 2), (2, "f", 2), (5, "z", 1), (7, "y", 1)]


def test_interface_targets(spark):
    methods = spark.createDataFrame([("i.run", "I", "run"), ("a.run", "A", "run"), ("i.stop", "I", "stop"), ("a.go", "A", "go"), ("b.go", "B", "go"), ("i.go", "I", "go")], "id string, owner string, name string")
    calls = spark.createDataFrame([(1, "I", "run"), (2, "I", "stop"), (3, "I", "go"), (4, "A", "go"), (5, "X", "stop"), (6, "I", "none")], "site int, interface string, name string")
    assert {r.site: r.id for r in resolution.interface_targets(calls, methods).collect()} == {1: "a.run", 2: "i.stop", 5: "i.stop"}


def test_plan_order(spark):
    hits = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("4",), ("9",)], "path string")
    modules = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "c"), ("5", "d")], "path string, module string")
    edges = spark.createDataFrame([("a", "c"), ("a", "c"), ("b", "c"), ("c", "b"), ("c", "c"), ("a", "d")], "src string, dst string")
    plan = planning.slices(hits, modules, edges)
    assert sorted((r.id, r.files, r.deps) for r in plan.collect()) == [("a", 1, ["c"]), ("b", 1, []), ("c", 2, [])]
    assert [r.id for r in planning.in_order(plan).orderBy("step").collect()] == ["b", "c", "a"]
    ring = spark.createDataFrame([("x", ["z"]), ("y", ["x"]), ("z", ["y"]), ("w", ["z"])], "id string, deps array<string>")
    assert [r.id for r in planning.in_order(ring).orderBy("step").collect()] == ["w", "x", "y", "z"]


def brute_territories(files, enough, most):
    areas, tried = {"."}, set()
    folder = {p: p.rpartition("/")[0] or "." for p in files}
    own = lambda p: max((a for a in areas if a == "." or folder[p] == a or folder[p].startswith(a + "/")), key=lambda a: 0 if a == "." else a.count("/") + 1)
    while len(areas) < enough:
        size = {}
        for p in files:
            size[own(p)] = size.get(own(p), 0) + 1
        left = [a for a in size if a not in tried]
        if not left:
            break
        big = min(left, key=lambda a: (-size[a], a))
        tried.add(big)
        kids = set()
        for p in files:
            rest = p if big == "." else p[len(big) + 1 :]
            if own(p) == big and "/" in rest:
                kids.add(rest.split("/")[0] if big == "." else f"{big}/{rest.split('/')[0]}")
        if kids and len(areas) + len(kids) <= most:
            areas |= kids
    out = {}
    for p in files:
        out[own(p)] = out.get(own(p), 0) + 1
    return out


def test_territories_equal_plain_code(spark):
    rng = random.Random(3)
    for enough, most in ((6, 9), (18, 28)):
        files = sorted({"/".join([rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 3))] + [f"f{i}"]) for i in range(150)})
        got = {r.area: r.files for r in planning.territories(spark.createDataFrame([(f,) for f in files], "path string"), enough, most).collect()}
        assert got == brute_territories(files, enough, most)


def test_typed_links(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "c", "CALLS"), ("f", "g", "IMPORTS"), ("a", "zz", "CALLS"), ("a", "b", "HANDLES")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("a", "function", "f"), ("b", "function", "g"), ("c", "class", "g"), ("f", "file", "f"), ("g", "file", "g")], "id string, kind string, file string")
    assert sorted((r.src, r.dst, r.base) for r in planning.typed_links(edges, nodes).collect()) == [("a", "b", "calls"), ("a", "c", "types"), ("f", "g", "imports")]


def test_declared_tables(spark):
    text = """CREATE TABLE IF NOT EXISTS "Shop"."Orders" (a int); -- create table no (a)
    create or replace temp table [x y] (); /* create table never () */ insert into t values ('create table text (');
    ALTER TABLE ONLY public.orders ADD b int; create view v as select * from Orders join `x y` on true; create tablespace s"""
    df = spark.createDataFrame([("a.sql", text), ("b.sql", None), ("c.py", "create table c ()"), ("d.sql", "update orders set a = 1")], "path string, text string")
    assert sorted((r.path, r.table, r.times) for r in table_scan.declared_tables(df).collect()) == [("a.sql", "orders", 2), ("a.sql", "x y", 1)]
    assert sorted((r.path, r.table, r.declared_in) for r in table_scan.used_tables(df).collect()) == [("a.sql", "orders", "a.sql"), ("a.sql", "x y", "a.sql"), ("d.sql", "orders", "a.sql")]
    assert df.where("false").select(F.lit("x.sql").alias("path"), "text").transform(table_scan.declared_tables).count() == 0
