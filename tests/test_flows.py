"""Flow maps, definitions, models, aliases, groups and teams on literal cases and against plain code."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import flowmap, planning, resolution
from weftgraph.sources import definitions, table_scan

BODY = ["fn main() {", "    let cfg = zeta_load();", "    if cfg > 1 {", "        alpha_save(cfg);", "    }", "", "    for i in 0..cfg {", "        mid_step (i);", "        if x_beta() {", "            y()", "        }", "    }",
        "    beta::<T>(1);", "    items.forEach(x =>", "        zip!(x))", "    while cond() {", "    }", "}", "    after()"]


def test_call_sites(spark):
    want = {"zeta_load": (5, None), "alpha_save": (7, "if"), "mid_step": (11, "loop"), "x_beta": (12, "loop"), "y": (13, "if"), "beta": (16, None), "zip": (18, "loop"), "cond": (19, None), "load": None, "": None, "main": None, ".*": None}
    rows = spark.createDataFrame([(4, BODY, n) for n in want], "first int, body array<string>, name string")
    got = {r.name: tuple(r.at) if r.at else None for r in rows.select("name", flowmap.call_site(F.col("body"), F.col("first"), F.col("name")).alias("at")).collect()}
    assert got == want
    none = spark.createDataFrame([(1, None, "a"), (1, [], "a"), (1, ["a()"], "a")], "first int, body array<string>, name string")
    assert {r.at for r in none.select(flowmap.call_site(F.col("body"), F.col("first"), F.col("name")).alias("at")).collect()} == {None}


def _plain_flow(entry, kids, depth, most):
    """The recursive walk, with all calls at hand."""
    steps, seen = [(entry, 0, -1)], {entry}

    def go(at):
        node, level, _ = steps[at]
        if level >= depth or len(steps) >= most:
            return
        for kid in kids.get(node, []):
            if len(steps) >= most:
                break
            if kid not in seen:
                seen.add(kid)
                steps.append((kid, level + 1, at))
                go(len(steps) - 1)

    go(0)
    return steps


def test_flows_are_those_of_the_plain_walk(spark):
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}"): rng.choice([0, 0, 1, 2, 3, 9]) for _ in range(260)}
    edges |= {("hub", f"n{k}"): 1 for k in range(60)} | {("chain", "n1"): 1}
    calls = spark.createDataFrame([(a, b, b, s, None, 2) for (a, b), s in edges.items()], "src string, dst string, name string, site long, branch string, tier int")
    kids: dict[str, list[str]] = {}
    for (a, b), s in sorted(edges.items(), key=lambda e: (e[0][0], e[1] == 0, e[1], e[0][1])):
        kids.setdefault(a, []).append(b)
    names = [*{a for a, _ in edges}, "lonely"]
    starts = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "id string")
    for depth, most in ((4, 40), (3, 7), (1, 40)):
        got: dict[str, list] = {}
        for r in flowmap.unrolled(starts, calls, depth, most).orderBy("entry", "step").collect():
            got.setdefault(r.entry, []).append((r.id, r.depth, r.parent))
            assert r.site == (edges[(got[r.entry][r.parent][0], r.id)] if r.parent >= 0 else 0)
        assert got == {n: _plain_flow(n, kids, depth, most) for n in names}
    assert flowmap.unrolled(starts.where("false"), calls).count() == 0


def test_entries_and_domains(spark):
    routes = spark.createDataFrame([("GET /b", "h"), ("GET /a", "h")], "route string, id string")
    nodes = spark.createDataFrame([("h", "function", "main", False), ("m", "function", "main", False), ("e", "method", "e", False), ("t", "function", "t", True), ("c", "class", "c", False), ("x", "function", "x", False)], "id string, kind string, name string, test boolean")
    calls = spark.createDataFrame([(a, b) for a in ("h", "m", "e", "t", "c") for b in ("x", "y")], "src string, dst string")
    got = {(r.id, r.kind, r.route) for r in flowmap.entries(routes, nodes, calls).collect()}
    assert got == {("h", "route", "GET /a"), ("m", "main", None), ("e", "entry", None), ("t", "test", None)}
    starts = flowmap.entries(routes, nodes, calls)
    full = calls.select("src", "dst", F.col("dst").alias("name"), F.lit(1).cast("long").alias("site"), F.lit(None).cast("string").alias("branch"), F.lit(2).alias("tier"))
    places = spark.createDataFrame([(n, n, f"src/{d}/{n}.rs", d) for n, d in (("h", "a"), ("m", "b"), ("e", "b"), ("t", "b"), ("x", "b"), ("y", "b"))], "id string, name string, path string, domain string")
    steps = flowmap.unrolled(starts, full)
    found = flowmap.flows(starts, steps, places)
    assert [(r.entry, r.kind, r.steps, r.files) for r in found.collect()] == [("h", "route", 3, 3), ("m", "main", 3, 3), ("e", "entry", 3, 3), ("t", "test", 3, 3)]
    assert {(r.domain, r.label, r.flows, r.files) for r in flowmap.domains(found, steps, places).collect()} == {("a", "src", 1, 3), ("b", "src/b", 3, 5)}


SOURCES = {
    "a.py": ("python", 'import os\nfrom .a import b\nclass Shop(Base):\n    """def no(): pass"""\n    def sell(self, x):\n        y = f(x)  # g(x)\n        return self.pay("h(z)", y)\n\n    async def pay(\n        self,\n    ):\n        pass\ndef main():\n    Shop().sell(1)\n'),
    "a.ts": ("typescript", "import {x,\n y} from './x';\nexport class A {\n  run(a: number) {\n    if (a) {\n      helper(a);\n    }\n  }\n}\nexport const go = async (q) => {\n  return api.send(q);\n};\nfunction helper(a) { return 'f(1)'; }\n"),
    "a.rs": ("rust", "use crate::a::b;\npub struct S { x: u8 }\nimpl Show for S {\n    fn show<'a>(&'a self) -> u8 {\n        inner::leaf(self.x)\n    }\n}\nfn one() {}\nfn main() {\n    let s = 'x';\n    println!(\"{}\", one());\n}\n"),
    "a.go": ("go", 'package m\nimport (\n\t"a/b"\n)\ntype T struct {\n\ta int\n}\nfunc (t *T) Do() {\n\tfmt.Println(help("x(1)"))\n}\nfunc help(s string) string { return s }\n'),
    "a.vue": ("vue", '<template>é<a>f(1)</a></template>\n<script lang="ts">\nfunction v() {\n  w();\n}\n</script>\n<style>x</style>'),
    "n.py": ("python", None),
    "e.py": ("python", ""),
}


def _sources(spark):
    return spark.createDataFrame([(p, lang, t) for p, (lang, t) in SOURCES.items()], "path string, lang string, text string")


def test_definitions(spark):
    got = {tuple(r)[:6] for r in definitions.definitions(_sources(spark)).collect()}
    assert got == {
        ("a.py", "class", "Shop", None, 3, 12), ("a.py", "method", "sell", "Shop", 5, 7), ("a.py", "method", "pay", "Shop", 9, 12), ("a.py", "function", "main", None, 13, 14),
        ("a.ts", "class", "A", None, 3, 9), ("a.ts", "method", "run", "A", 4, 8), ("a.ts", "function", "go", None, 10, 12), ("a.ts", "function", "helper", None, 13, 13),
        ("a.rs", "class", "S", None, 2, 2), ("a.rs", "impl", "S", None, 3, 7), ("a.rs", "method", "show", "S", 4, 6), ("a.rs", "function", "one", None, 8, 8), ("a.rs", "function", "main", None, 9, 12),
        ("a.go", "class", "T", None, 5, 7), ("a.go", "method", "Do", None, 8, 10), ("a.go", "function", "help", None, 11, 11), ("a.vue", "function", "v", None, 3, 5),
    }
    body = definitions.definitions(_sources(spark)).where("name = 'sell'").first().body
    assert body == '    def sell(self, x):\n        y = f(x)  # g(x)\n        return self.pay("h(z)", y)'


def test_calls_and_imports(spark):
    calls = {tuple(r) for r in definitions.call_names(_sources(spark)).collect()}
    assert calls == {
        ("a.py", 6, None, "f"), ("a.py", 7, "self", "pay"), ("a.py", 14, None, "Shop"), ("a.py", 14, "()", "sell"), ("a.ts", 6, None, "helper"), ("a.ts", 11, "api", "send"), ("a.rs", 5, "inner", "leaf"),
        ("a.rs", 11, None, "println"), ("a.rs", 11, None, "one"), ("a.go", 9, "fmt", "Println"), ("a.go", 9, None, "help"), ("a.vue", 4, None, "w"),
    }
    found = {(r.path, r.raw) for r in definitions.imports(_sources(spark)).collect()}
    assert found == {("a.py", "os"), ("a.py", ".a"), ("a.ts", "./x"), ("a.rs", "crate::a::b"), ("a.go", "a/b")}


def test_masks_keep_every_byte(spark):
    texts = ["a = 'é' # ü😀\nb", '"""x\ny""" + \'q\\\'r\' z', "// c\n`t\n` /* é\n*/ k 'open\nq", "", None, "x" * 200_000 + "'" + "y" * 200_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for style in definitions.HIDDEN:
        for r in rows.select("t", definitions.masked(F.col("t"), style).alias("m")).collect():
            assert len(r.m.encode()) == len((r.t or "").encode()) and r.m.count("\n") == (r.t or "").count("\n")
    got = [r.m for r in rows.select(definitions.masked(F.col("t"), "python").alias("m")).collect()]
    assert got[0].split() == ["a", "=", "b"] and got[1].split() == ["+", "z"]
    page = spark.createDataFrame([("vue", "<p>ü😀</p><SCRIPT a>é(1)</script>\n<script>b"), ("astro", "---\nimport a from 'b'\n---\n<p>é</p>"), ("rust", "<script>")], "lang string, t string")
    kept = [(r.t, r.k) for r in page.select("t", definitions.script_parts(F.col("t"), F.col("lang")).alias("k")).collect()]
    assert [k.split() for _, k in kept] == [["é(1)", "b"], ["import", "a", "from", "'b'"], ["<script>"]]
    assert all(len(t.encode()) == len(k.encode()) for t, k in kept)


def test_models(spark):
    rows = [
        ("shop/models/a.py", "python", 'from django.db import models\nclass Base(models.Model):\n    class Meta:\n        abstract = True\n\nclass Order(Base):\n    class Meta:\n        db_table = "shop_orders"\nclass Item(\n    Base,\n):\n    x = 1\n"""\nclass Never(models.Model):\n    pass\n"""\nclass Other: pass\n'),
        ("b.py", "python", 'class U(Base):\n    __tablename__ = "Users"\nclass A(Base):\n    __abstract__ = True\n    __tablename__ = "no"\n'),
        ("c.ts", "typescript", "const app = pgSchema(\"app\"); // pgTable(\"never\")\nexport const users = pgTable(\"users\", {});\nconst make = pgTableCreator((n) => `proj_${n}_x`);\nexport const posts = make(\"posts\", {});\nconst t = app.table('things', {}); const s = \"pgTable('no')\";\nmyPgTable(\"no2\"); mysqlTable(\n  `my`);\n"),
        ("d.ts", "typescript", "db.table('no')"), ("e.prisma", "prisma", 'model User {\n  id Int\n  @@map(name: "people")\n}\nmodel Pet {\n  id Int\n}\n'), ("n.py", "python", None),
    ]
    got = {tuple(r) for r in table_scan.declared_models(spark.createDataFrame(rows, "path string, lang string, text string")).collect()}
    assert got == {
        ("shop/models/a.py", "shop_orders", "Order"), ("shop/models/a.py", "shop_item", "Item"), ("b.py", "users", "U"), ("c.ts", "users", "users"), ("c.ts", "proj_posts_x", "posts"), ("c.ts", "things", "t"), ("c.ts", "my", None),
        ("e.prisma", "people", "User"), ("e.prisma", "pet", "Pet"),
    }


def test_aliases(spark):
    files = spark.createDataFrame([("web/src/a.ts",), ("web/lib/index.ts",), ("web/x/y.ts",)], "path string")
    rows = [(0, "'@/a'"), (1, "~lib"), (2, "x/y"), (3, "@/none"), (4, "react"), (5, "'@/a.ts'")]
    imports = spark.createDataFrame([(n, "web/src/m.ts", "typescript", raw) for n, raw in rows], "site int, path string, lang string, raw string")
    aliases = (("@/*", "src/*"), ("~lib", "lib"))
    assert {(r.site, r.target) for r in resolution.import_files(imports, files, aliases=aliases, base_url="web").collect()} == {(0, "web/src/a.ts"), (1, "web/lib/index.ts"), (2, "web/x/y.ts"), (5, "web/src/a.ts")}
    assert resolution.import_files(imports, files).count() == 0


def _plain_groups(paths, most=12, extra=4, share=0.3):
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else "."
    dirs = [up(p) for p in paths]
    areas = {d.split("/")[0] for d in dirs}
    owner = lambda d: max((a for a in areas if a != "." and (d == a or d.startswith(a + "/"))), key=len, default=".")

    def large():
        sizes = {o: sum(owner(d) == o for d in dirs) for o in {owner(d) for d in dirs}}
        return sorted((o for o, n in sizes.items() if n >= share * len(dirs)), key=lambda o: (-sizes[o], o))

    split = True
    while split:
        split = False
        for big in large():
            kids = {("" if big == "." else big + "/") + (d if big == "." else d[len(big) + 1 :]).split("/")[0] for d in dirs if owner(d) == big and d != big}
            direct = big in dirs
            if kids and len(kids) + direct >= 2 and len(areas) - 1 + len(kids) + direct <= most:
                areas = (areas if direct else areas - {big}) | kids
                split = True
                break
    flat = [b for b in large() if 2 <= len({p for p in paths if up(p) == b and owner(b) == b}) <= most + extra - len(areas) + 1]
    out: dict[str, int] = {}
    for p in paths:
        key = p if owner(up(p)) in flat and up(p) == owner(up(p)) else owner(up(p))
        out[key] = out.get(key, 0) + 1
    return out


def test_groups(spark):
    rng = random.Random(2)
    for n in range(6):
        tops = ["src", "src", "src", "doc", "web"] if n < 4 else [f"t{k}" for k in range(14 if n == 4 else 25)]
        paths = sorted({"/".join([rng.choice(tops), *(rng.choice("abc") for _ in range(rng.randrange(3))), f"f{k}"]) for k in range(40)} | ({"root.md"} if n % 2 else set()))
        got = {r.grp: r.files for r in planning.groups(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
        assert got == _plain_groups(paths), n
    assert planning.groups(spark.createDataFrame([], "path string")).count() == 0


def test_team(spark):
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "c", "a"), (3, "a", "a"), (4, "c", "d"), (5, "a", "b")], "rank int, from string, to string")
    assert {tuple(r) for r in planning.hand_off_deps(pairs).collect()} == {("b", "a"), ("c", "b"), ("d", "c")}
    assert planning.hand_off_deps(pairs.where("false")).count() == 0
    scopes = spark.createDataFrame([("s1", "src/"), ("s2", "doc"), ("s3", None), ("s4", "src/x"), ("s4", "lib")], "seat string, prefix string")
    files = spark.createDataFrame([("src/x/1",), ("src/y",), ("z",), ("src/y",)], "path string")
    got = {tuple(r) for r in planning.seat_scopes(scopes, files).collect()}
    assert got == {("s1", "src/x/1"), ("s1", "src/y"), ("s2", "doc"), ("s3", "src/x/1"), ("s3", "src/y"), ("s3", "z"), ("s4", "src/x/1")}
    assert {tuple(r) for r in planning.seat_scopes(scopes, files.where("false")).collect()} == {("s1", "src/"), ("s2", "doc"), ("s3", "."), ("s4", "src/x"), ("s4", "lib")}


def test_lines_of_a_node_are_marked_once_for_all_of_its_calls(spark):
    nodes = spark.createDataFrame([("s", 10, ["def f():", "    if ok:", "", "        a()", "    b()"])], "id string, first int, body array<string>")
    calls = spark.createDataFrame([("s", x, x, 2) for x in "abc"] + [("t", "a", "a", 2)], "src string, dst string, name string, tier int")
    found = flowmap.placed(calls, nodes)
    assert {(r.src, r.dst): (r.site, r.branch) for r in found.collect()} == {("s", "a"): (13, "if"), ("s", "b"): (14, None), ("s", "c"): (0, None), ("t", "a"): (0, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join")
    # of the patterns only that of the name is matched for each call, and once
    assert above.count("RLIKE") + above.count("regexp_like") <= 1 and "regexp_extract" not in above and "regexp_extract" in below
