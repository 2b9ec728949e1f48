"""Extents, scopes and scoped paths on sources written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import scoped
from weftgraph.sources import definitions, rust_paths

MAIN = """
mod ink;
mod far;
mod left;
mod right;
mod shop;
mod cart;

#[path = "odd/gate.rs"]
mod gate;

use crate::shop::{tools::{draw, fill as brush}, Disc};
use crate::cart::Cart;
use self::ink::{blot, self as stain};
use crate::shop::parts::*;
use crate::left::*;
use crate::right::*;
use crate::far::near::{self};

fn entry() {
    draw(); brush(); blot("x"); gear();
    gate::opened();
    crate::shop::tools::draw();
    let c = Disc::make(2.0);
    Cart::make();
    crate::right::twin();
    both();
    far::outer();
    near::leaf();
    stain::blot("y");
    within::inside();
    far::again();
    crate::far::passed();
    Disc::<f64>::make(1.0);
    round::x();
    c.area();
}

mod within {
    pub fn inside() -> u32 { 1 }
}
"""
SOURCES = {
    "k/src/lib.rs": MAIN,
    "k/src/ink.rs": "pub fn blot(s: &str) -> usize { s.len() }\n",
    "k/src/shop.rs": """
pub mod tools {
    pub fn draw() {}
    pub fn fill() {}
}
pub mod parts {
    pub fn gear() -> u32 { 1 }
}
pub struct Disc { r: f64 }
impl Disc {
    pub fn make(r: f64) -> Self { Self::check(); Disc { r } }
    pub fn check() {}
    pub fn area(&self) -> f64 { 3.0 }
}
""",
    "k/src/cart.rs": "pub struct Cart;\nimpl Cart {\n    pub fn make() -> Self { Cart }\n}\npub struct Other;\nimpl Other {\n    pub fn make() -> Self { Other }\n}\n",
    "k/src/odd/gate.rs": "pub fn opened() {}\n",
    "k/src/far/mod.rs": "mod near;\nuse super::ink::blot;\npub use self::near::{leaf as passed, deep::again};\npub use crate::round as circle;\npub fn outer() {\n    near::leaf();\n    blot(\"x\");\n    super::right::twin();\n    ink::blot(\"root\");\n}\n",
    "k/src/far/near.rs": "pub fn leaf() {}\npub mod deep;\n",
    "k/src/far/near/deep.rs": "pub fn again() {}\n",
    "k/src/left.rs": "pub fn twin() {}\npub fn both() {}\n",
    "k/src/right.rs": "pub fn twin() {}\npub fn both() {}\nuse crate::right::ring as ring2;\nuse ring2 as ring;\nfn f() { ring::x(); }\n",
    "other/src/lib.rs": "fn f() { crate::ink::blot(); shop::x(); }\n",
}


def frame(spark, sources):
    return spark.createDataFrame([(p, "rust", t) for p, t in sources.items()], "path string, lang string, text string")


def targets(spark, files):
    defs = definitions.definitions(files).where("kind in ('function', 'method')").select(F.concat("path", F.lit(":"), "first", F.lit(":"), "name").alias("id"), "path", "name", F.when(F.col("kind") == "method", F.col("owner")).alias("owner"))
    calls = rust_paths.called_paths(files).join(definitions.line_scopes(files), ["path", "line"])
    asked = scoped.own_paths(calls)
    got = scoped.scoped_targets(asked.select("path", "asked"), files, defs, rust_paths.uses(files), rust_paths.declared_modules(files))
    return {(r.path.removeprefix("k/src/"), r.asked): ":".join(r.id.removeprefix("k/src/").split(":")[::2]) for r in got.collect()}


def test_paths_of_a_crate(spark):
    got = targets(spark, frame(spark, SOURCES))
    assert got == {
        ("lib.rs", "draw"): "shop.rs:draw", ("lib.rs", "brush"): "shop.rs:fill", ("lib.rs", "blot"): "ink.rs:blot", ("lib.rs", "gear"): "shop.rs:gear",
        ("lib.rs", "gate::opened"): "odd/gate.rs:opened", ("lib.rs", "crate::shop::tools::draw"): "shop.rs:draw", ("lib.rs", "Disc::make"): "shop.rs:make",
        ("lib.rs", "Cart::make"): "cart.rs:make", ("lib.rs", "crate::right::twin"): "right.rs:twin", ("lib.rs", "far::outer"): "far/mod.rs:outer",
        ("lib.rs", "near::leaf"): "far/near.rs:leaf", ("lib.rs", "stain::blot"): "ink.rs:blot", ("lib.rs", "far::again"): "far/near/deep.rs:again",
        ("lib.rs", "crate::far::passed"): "far/near.rs:leaf", ("shop.rs", "Disc::check"): "shop.rs:check", ("far/mod.rs", "near::leaf"): "far/near.rs:leaf",
        ("far/mod.rs", "blot"): "ink.rs:blot", ("far/mod.rs", "super::right::twin"): "right.rs:twin", ("far/mod.rs", "ink::blot"): "ink.rs:blot",
    }


def test_no_crate_no_paths(spark):
    empty = frame(spark, SOURCES).where("false")
    assert targets(spark, empty) == {}
    assert targets(spark, spark.createDataFrame([("a.rs", "rust", None), ("b.rs", "rust", "")], "path string, lang string, text string")) == {}


def test_use_trees(spark):
    trees = ["a::b", "a::{b, c::{d as e, self}, *}", "{a, b::{c}}", "a::{ b ,\n c }", "a::{{b}}", "a::{}", "a::b as _", "::std::io"]
    df = spark.createDataFrame([(f"f{k}.rs", "rust", f"use {t};") for k, t in enumerate(trees)], "path string, lang string, text string")
    got = {}
    for r in rust_paths.uses(df).collect():
        got.setdefault(int(r.path[1:-3]), set()).add((r.local, r.target))
    assert got == {
        0: {("b", "a::b")}, 1: {("b", "a::b"), ("e", "a::c::d"), ("c", "a::c"), ("*", "a::*")}, 2: {("a", "a"), ("c", "b::c")}, 3: {("b", "a::b"), ("c", "a::c")},
        4: {("b", "a::b")}, 7: {("io", "std::io")},
    }


def plain_extents(lines):
    """Each definition searches on from its own line."""
    marks = [(i + 1, len(x) - len(x.lstrip()), x.strip()[0], x) for i, x in enumerate(lines) if x.strip()]
    out = []
    for k, (i, at, _, x) in enumerate(marks):
        words = x.split()
        if words[0] in ("def", "class"):
            stop = next((j for j in range(k + 1, len(marks)) if marks[j][1] <= at and marks[j][2] not in "){"), len(marks))
            out.append((words[1].split("(")[0].rstrip(":"), i, marks[stop - 1][0]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_extents_equal_plain_search(spark, seed):
    import random

    rng = random.Random(seed)
    lines = [" " * rng.choice([0, 0, 2, 4, 6]) + rng.choice([f"def f{k}(a):", f"class C{k}:", "x = 1", "", ")"]) for k in range(300)]
    df = spark.createDataFrame([("a.py", "python", "\n".join(lines)), ("n.py", "python", None)], "path string, lang string, text string")
    rows = definitions.definitions(df).collect()
    assert sorted((r.name, r.first, r.last) for r in rows) == sorted(plain_extents(lines))
    spans = {r.first: (r.first, r.last, r.name) for r in rows}
    for r in rows:
        around = [s for s in spans.values() if s[0] < r.first and s[1] >= r.last]
        assert r.owner == (max(around)[2] if around else None)
    for r in definitions.line_scopes(df).collect():
        inside = sorted((s for s in spans.values() if s[0] <= r.line <= s[1]), reverse=True)
        kinds = {x.first: x.kind for x in rows}
        assert r.chain == [*[s[0] for k, s in enumerate(inside) if k == 0 or kinds[s[0]] != "class"], 0] and r.scope == r.chain[0] and r.name == (inside[0][2] if inside else None)


def test_thousands_of_definitions_in_a_file_take_seconds(spark):
    text = "\n".join(f"class C{k}:\n    def f{k}(self):\n        return {k}" for k in range(2500))
    began = time.time()
    got = definitions.definitions(spark.createDataFrame([("big.py", "python", text)], "path string, lang string, text string"))
    assert got.agg(F.count(F.lit(1)), F.sum(F.length("body"))).first()[0] == 5000
    assert time.time() - began < 20


PAGE = """import Base, { Disc as D, type Cart } from './shop'
import * as ink from './ink'
const top: Cart = make();
class Room {
  seat = 1;
  open(d: D, n?: number) {
    const far = new ink.Pen();
    let plain = 3;
    if (n) {
      return d.area() + far.write() + top.sum();
    }
  }
}
function dark(top) {
  const top = other();
  const two = new D();
  var two: Cart = 1;
  return top.sum() + two.area();
}
"""


def test_names_that_sources_bind(spark):
    from weftgraph.sources import bindings

    rows = [
        ("a.ts", "typescript", PAGE),
        ("b.py", "python", "from .shop import (Disc as D,\n  Cart)\nimport os.path, sys\nimport ink as i\nx: D = make()\ny = shop.Cart(1)\nz = y\ndef f(a: D, b: 'Q', *c):\n    w == D()\n"),
        ("c.rs", "rust", "fn f(a: &mut Disc, b: u8) {\n let mut x = shop::Cart::new(1);\n let y: &Disc = g();\n let z = h();\n}\n"),
        ("d.go", "go", "func f(a *Disc, b int) {\n x := &Cart{1}\n y := g()\n}\n"), ("n.py", "python", None),
    ]
    df = spark.createDataFrame(rows, "path string, lang string, text string")
    got = {(r.path[0], r.raw, r.local, r.exported) for r in bindings.named_imports(df).collect()}
    assert got == {
        ("a", "./shop", "Base", "default"), ("a", "./shop", "D", "Disc"), ("a", "./shop", "Cart", "Cart"), ("a", "./ink", "ink", None),
        ("b", ".shop", "D", "Disc"), ("b", ".shop", "Cart", "Cart"), ("b", "os.path", "os.path", None), ("b", "ink", "i", None),
    }
    found = {(r.path[0], r.line, r.local, r.type) for r in bindings.bound_locals(df).collect()}
    assert found >= {("a", 3, "top", "Cart"), ("a", 6, "d", "D"), ("a", 7, "far", "Pen"), ("a", 8, "plain", None), ("a", 15, "top", None), ("a", 16, "two", "D"), ("a", 17, "two", "Cart")}
    assert {f for f in found if f[0] == "b"} == {("b", 5, "x", "D"), ("b", 6, "y", "Cart"), ("b", 7, "z", None), ("b", 8, "a", "D")}
    assert {f for f in found if f[0] == "c"} == {("c", 1, "a", "Disc"), ("c", 2, "x", "Cart"), ("c", 3, "y", "Disc"), ("c", 4, "z", None)}
    assert {f for f in found if f[0] == "d"} == {("d", 1, "a", "Disc"), ("d", 2, "x", "Cart"), ("d", 3, "y", None)}


def test_the_nearest_scope_that_binds_a_name_decides(spark):
    from weftgraph.operators import resolution

    bound = [("p", 0, "a", "A"), ("p", 0, "b", "B"), ("p", 5, "a", "C"), ("p", 7, "b", None), ("p", 9, "a", "A"), ("p", 9, "a", "B"), ("q", 0, "a", "Z"), ("p", 9, "b", "B"), ("p", 9, "b", None)]
    uses = [("p", 7, [7, 5, 0], "a"), ("p", 7, [7, 5, 0], "b"), ("p", 5, [5, 0], "b"), ("p", 9, [9, 0], "a"), ("p", 9, [9, 0], "b"), ("p", 0, [0], "a"), ("p", 0, [0], "none"), ("q", 3, [3, 0], "a"), ("p", 0, [0], "a")]
    got = resolution.visible_types(spark.createDataFrame(uses, "path string, scope int, chain array<int>, local string"), spark.createDataFrame(bound, "path string, scope int, local string, type string"))
    assert sorted(map(tuple, got.collect())) == [("p", 0, "a", "A"), ("p", 5, "b", "B"), ("p", 7, "a", "C"), ("q", 3, "a", "Z")]
