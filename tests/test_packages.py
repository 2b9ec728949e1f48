"""Packages of imports, and ledgers from histories and copies."""

from pyspark.sql import functions as F

from weftgraph.functions import packages
from weftgraph.operators import ledger, linking

NAMES = [
    ("typescript", "'@scope/pkg/x'", "@scope/pkg"), ("javascript", "lodash/fp", "lodash"), ("tsx", "node:fs/promises", "node:fs"), ("tsx", "./a", None), ("tsx", "@/a", None), ("tsx", "~/a", None), ("tsx", "@only", None), ("tsx", "/a", None),
    ("python", "numpy.linalg", "numpy"), ("python", ".near", None), ("rust", "serde::Deserialize", "serde"), ("rust", "crate::a::b", None), ("rust", "near", None), ("rust", "super::x", None), ("rust", "selfish::x", "selfish"),
    ("go", '"host.org/a/b/c"', "host.org/a/b"), ("go", "fmt", "fmt"), ("go", "net/http", "net"), ("ruby", "x", None), ("python", "", None), ("python", None, None), ("typescript", "a b", None),
]


def test_packages_of_imports(spark):
    df = spark.createDataFrame(NAMES, "lang string, raw string, want string")
    wrong = df.withColumn("got", packages.package_name(F.col("raw"), F.col("lang"))).where("not (got <=> want)")
    assert wrong.collect() == []
    tests = [("npm", "fs", True), ("npm", "node:x", True), ("npm", "left-pad", False), ("pypi", "os", True), ("pypi", "numpy", False), ("cargo", "std", True), ("go", "fmt", True), ("go", "host.org/a", False), ("other", "x", False)]
    df = spark.createDataFrame(tests, "eco string, name string, want boolean")
    assert df.where(packages.runtime_module(F.col("eco"), F.col("name")) != F.col("want")).collect() == []


def test_from_raw_imports_to_verdicts(spark):
    imports = spark.createDataFrame([(1, "a.py", "python", "os"), (2, "a.py", "python", "Py_Yaml.x"), (3, "b.py", "python", "py_yaml"), (4, "a.py", "python", "mine"), (5, "c.rs", "rust", "my_crate::x"), (6, "d.ts", "tsx", "left-pad")], "site int, path string, lang string, raw string")
    declared = spark.createDataFrame([("pypi", "py-yaml"), ("cargo", "my-crate"), ("npm", "idle"), ("npm", "my_crate")], "ecosystem string, name string")
    got = linking.package_report(imports, spark.createDataFrame([(4,)], "site int"), declared)
    assert sorted(map(tuple, got.collect())) == [("cargo", "my_crate", 1, "used"), ("npm", "idle", 0, "unused"), ("npm", "left-pad", 1, "undeclared"), ("npm", "my_crate", 0, "unused"), ("pypi", "py_yaml", 2, "used")]


def test_ledger_of_a_finished_plan(spark):
    rows = [
        ("r", "a", 10, "queued", None, 0, 0.0), ("r", "a", 20, "running", None, 5, 0.1), ("r", "a", 30, "rejected", "Tests failed", 5, 0.0), ("r", "a", 40, "running", None, 1, None), ("r", "a", 50, "passed", "", None, 0.0),
        ("r", "b", 10, "running", None, 0, 0.0), ("r", "b", 20, "rejected", "a TEST broke", 0, 0.0), ("r", "c", 5, "running", "scope", 0, 0.0), ("s", "a", 1, "rejected", "scope", 0, 0.0),
    ]
    changes = spark.createDataFrame(rows, "run string, slice string, at long, state string, reason string, tokens long, cost double")
    refusals = spark.createDataFrame([("r", "a"), ("r", "a"), ("x", "a")], "run string, slice string")
    got = {(r.run, r.slice): (r.verdict, r.tests, r.attempts, r.refusals, r.tokens, r.duration_ms, r.passed) for r in ledger.ledger_seats(changes, refusals).collect()}
    assert got == {
        ("r", "a"): ("passed", True, 2, 2, 11, 40, True), ("r", "b"): ("rejected", False, 1, 0, 0, 10, False), ("r", "c"): ("failed", None, 1, 0, 0, 0, False), ("s", "a"): ("rejected", None, 0, 0, 0, 0, False),
    }
    assert {r.tests for r in ledger.ledger_seats(changes, refusals, tested=False).collect()} == {None}
    assert ledger.ledger_seats(changes.where("false"), refusals).count() == 0


def test_file_copies_win(spark):
    schema = "id string, ended long, state string"
    documents = spark.createDataFrame([("a", 9, "doc"), ("b", 1, "doc"), ("b", 2, "doc2")], schema)
    files = spark.createDataFrame([("a", 1, "file"), ("c", None, "file")], schema)
    assert sorted(map(tuple, ledger.ledger_copies(files, documents).collect()), key=str) == [("a", 1, "file"), ("b", 2, "doc2"), ("c", None, "file")]


def test_declared_programs(spark):
    from weftgraph.sources import code_files

    files = [
        ("Cargo.toml", "[[bin]]\nname = \"a\"\n\n[[bin]]\npath = \"x.rs\"\nname = 'b'\n[lib]\nname = \"no\"\n"), ("k/Cargo.toml", "[[bin]]\npath = 'only.rs'\n"), ("k/NotCargo.toml", "[[bin]]\nname = 'no'\n"),
        ("p/pyproject.toml", "[project.scripts]\nrun = \"pkg.cli:main\"\n\"two-b\" = \"pkg\"\n[tool.poetry.scripts]\nthree = 'gone.mod : f '\n[other]\nno = 'x:y'\n"), ("p/src/pkg/cli.py", ""), ("p/pkg/__init__.py", None), ("p/src/pkg/__init__.py", ""), ("q/pyproject.toml", None),
    ]
    got = code_files.declared_entries(spark.createDataFrame(files, "path string, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", "src/bin/a.rs"), ("b", "x.rs"), ("f", "p/pyproject.toml"), ("main", "p/src/pkg/cli.py"), ("two-b", "p/pkg/__init__.py")]


def test_changes_are_judged_by_the_symbols_they_touch(spark):
    from weftgraph.operators import policy

    rules = policy.with_own([policy.Rule("symbols", policy.SCOPE, symbols=("f", "g")), policy.Rule("core", policy.HIDDEN, globs=("core",))])
    spans = [("a.py", "f", 10, 900), ("a.py", "g", 300, 310), ("a.py", "h", 1, 9), ("a.py", "broken", 5, None), ("core/x.py", "f", 1, 5)]
    ranges = [(1, "a.py", 9, 9), (2, "a.py", 9, 10), (3, "a.py", 255, 305), (4, "core/x.py", 7, 8), (5, ".weftgraph/rules", 1, 1), (6, "a.py", 950, None), (7, "a.py", 256, 256), (7, "a.py", 900, 2000)]
    got = policy.touched_verdicts(spark.createDataFrame(ranges, "change int, path string, ra long, rb long"), spark.createDataFrame(spans, "path string, symbol string, first long, last long"), rules)
    assert sorted(map(tuple, got.collect())) == [
        (1, "a.py", 1, 0, "-"), (2, "a.py", 2, 1, "symbols"), (3, "a.py", 2, 1, "symbols"), (4, "core/x.py", 0, 3, "core"), (5, ".weftgraph/rules", 0, 2, "own configuration"), (6, "a.py", 0, 0, "-"), (7, "a.py", 1, 1, "symbols"),
    ]


def test_synopses_fit_a_page(spark):
    rows = [("r", "b", "rejected", False, 2, 1, 0, False, 10.0), ("r", "a", "passed", True, 1, 0, 7, True, 90.25), ("s", "x", "failed", None, 0, 3, 0, False, 5.0)]
    seats = spark.createDataFrame(rows, "run string, slice string, verdict string, tests boolean, attempts long, refusals long, tokens long, passed boolean, score double")
    lines = ledger.synopses(seats)
    got = {}
    for r in lines.orderBy("run", "no").collect():
        got.setdefault(r.run, []).append(r.text)
    assert got == {
        "r": ["1 of 2 seats passed, score 50.1, 7 tokens", "a passed", "b rejected, 2 attempts, 1 refusal by fences, tests failed", "Fences held on b"],
        "s": ["0 of 1 seats passed, score 5.0", "x failed, 3 refusals by fences", "Fences held on x"],
    }
    most = len("\n".join(got["r"][:2]))
    assert sorted((r.run, r.no) for r in ledger.one_page(lines, "run", most).collect()) == [("r", 0), ("r", 1), ("s", 0)]
    assert ledger.one_page(lines, "run", most - 1).where("run = 'r'").count() == 1
