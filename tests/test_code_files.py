"""Source trees, manifests and patches on literal files."""

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import code_files as c


def frame(spark, *rows, schema="path string, lang string, text string"):
    return spark.createDataFrame(list(rows), schema)


def test_scan(spark, tmp_path):
    for name, body in {"a.py": b"x", "sub/b.rs": b"fn", "node_modules/c.js": b"no", "big.py": b"y" * 50, "bad.bin": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = c.scan_files(spark, str(tmp_path), most_bytes=40).collect()
    assert {(r.path, r.text) for r in got} == {("a.py", "x"), ("sub/b.rs", "fn")}


def test_language(spark):
    want = {"a/b.py": "python", "x.blade.php": "blade", "x.y.php": "php", "Dockerfile": "dockerfile", "d/UP.RS": "rust", "none": None, "a.unknown": None, "": None}
    got = spark.createDataFrame([(p,) for p in want], "path string").select("path", c.language(F.col("path")).alias("lang")).collect()
    assert {r.path: r.lang for r in got} == want


def test_settle(spark):
    rows = [("objc", "x = 1;", "matlab"), ("matlab", "#import <a>", "objc"), ("v", "endmodule", "systemverilog"), ("python", "@end", "python"), (None, "x", None)]
    got = frame(spark, *rows, schema="lang string, text string, want string").select(c.settle(F.col("lang"), F.col("text")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_env(spark):
    files = frame(
        spark,
        ("a.ts", "typescript", "const x = process.env.API_URL\nconst y = process.env['KEY'] + process.env.API_URL"),
        ("b.py", "python", 'import os\nos.environ["A"], os.getenv( \'B\')\nos.environ.get("C", 1)\nos.getenv(name)'),
        ("c.rs", "rust", 'std::env::var("R")\nenv::var("S")\nother::env::var("T")'),
        ("d.go", "go", 'os.Getenv("G")'), ("e.rb", "ruby", 'os.Getenv("N")'), ("f.py", "python", None),
    )
    want = {("a.ts", "API_URL", 1), ("a.ts", "KEY", 2), ("a.ts", "API_URL", 2), ("b.py", "A", 2), ("b.py", "B", 2), ("b.py", "C", 3), ("c.rs", "R", 1), ("c.rs", "S", 2), ("d.go", "G", 1)}
    got = c.env_reads(files).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    example = frame(spark, (".env.example", None, "# a note\n\nA=1\n B_2 = x\nnot valid=3\nC"))
    assert {(r.key, r.line) for r in c.env_example(example).collect()} == {("A", 3), ("B_2", 4), ("C", 6)}


def test_fetched(spark):
    files = frame(spark, ("a.js", "javascript", "fetch('/api/x'); axios.get(`/y`)\nfetch('http://z/')"), ("b.py", "python", 'requests.put("/p")'))
    assert {tuple(r) for r in c.fetched_paths(files).collect()} == {("a.js", "/api/x", 1), ("a.js", "/y", 1), ("b.py", "/p", 1)}


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("w/package.json", '{"dependencies": {"left-pad": "1", "@scope/x": "2"}, "devDependencies": {"jest": "3"}}', {("left-pad", "npm", False), ("jest", "npm", False)}),
        ("package.json", "{broken", set()),
        ("Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\ntempfile = {version = "3"}', {("serde", "cargo", False), ("tempfile", "cargo", False)}),
        ("Cargo.lock", '[[package]]\nname = "syn"\nversion = "2"', {("syn", "cargo", True)}),
        ("pyproject.toml", '[project]\ndependencies = ["numpy>=1", "pandas"]\n[tool.poetry.dependencies]\npython = "3"\nrich = "1"', {("numpy", "pypi", False), ("pandas", "pypi", False), ("rich", "pypi", False)}),
        ("pyproject.toml", "[broken", set()),
        ("requirements-dev.txt", "# note\n-r base.txt\n\n  pytest==8\nflask[async]>=2", {("pytest", "pypi", False), ("flask", "pypi", False)}),
        ("go.mod", "module m\nrequire (\n\tgithub.com/a/b/v2 v2.0\n\t// note\n\tgolang.org/x/net v0 // indirect\n)\nrequire one.org/z v1", {("github.com/a/b", "go", False), ("golang.org/x/net", "go", False), ("one.org/z", "go", False)}),
        ("other.txt", "numpy", set()),
        ("Cargo.toml", None, set()),
    ],
)
def test_manifests(spark, path, text, want):
    got = c.manifest_deps(frame(spark, (path, None, text))).collect()
    assert {(r.name, r.ecosystem, r.from_lock) for r in got} == want and len(got) == len(want)


def test_patches(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ def f\n+a\n@@ -9 +11 @@\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -5,2 +4,0 @@\ndiff --git a/z b/z\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    got = c.changed_ranges(frame(spark, ("p", text), ("q", ""), ("r", None), schema="patch string, text string")).collect()
    assert {tuple(r) for r in got} == {("p", "x", 3, 6), ("p", "x", 11, 11), ("p", "y", 4, 4)}
    stat = c.numstat(frame(spark, ("p", "3\t1\ta\n-\t-\tb.png\n2\t0\t.own/c\nnoise"), schema="patch string, text string"), private=(".own",)).collect()
    assert [tuple(r) for r in stat] == [("p", 2, 3, 1)]
