"""Witnesses of a Merkle manifest against a tree that is built level by level."""

import hashlib
import random
import zlib

import pytest

from weftgraph.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, tree int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def walk(levels, k):
    """Siblings and their sides from a leaf up."""
    for nodes in levels[:-1]:
        yield nodes[k ^ 1] if k ^ 1 < len(nodes) else None, k % 2
        k //= 2


def fold(node, path):
    for other, right in path:
        node = digest(node) if other is None else digest(other, node) if right else digest(node, other)
    return node


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    leaf = lambda r, more=0: digest(field(r[0]), field(r[3]), field(r[2]), field(None if r[4] is None else r[4] + more), field(r[1]))
    by_lang, out = {}, []
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: levels_of([leaf(r) for r in by_lang[x]]) for x in names}
    upper = levels_of([trees[x][-1][0] for x in names])
    for i, x in enumerate(names):
        for k, r in enumerate(by_lang[x]):
            path = [*walk(trees[x], k), *walk(upper, i)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = fold(leaf(r, changed), path)
            out.append((r[0], leaf(r), trees[x][-1][0], upper[-1][0], digest(*[o for o, _ in path if o is not None]), end, end == upper[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 9, 31, 64, 65])
def test_a_growing_forest_has_the_witnesses_of_the_whole_tree(size):
    nodes, forest = [digest(str(k)) for k in range(size)], merkle.Forest()
    for node in nodes:
        forest.append(node)
    assert [h for h, _, _ in forest.open] == [b for b in range(7, -1, -1) if size >> b & 1]
    levels = levels_of(nodes)
    assert forest.close() == levels[-1][0]
    for k, w in enumerate(forest.witnesses):
        assert w == ["o" if o is None else ("l" if right else "r") + o for o, right in walk(levels, k)]


@pytest.mark.parametrize("levels", [3, merkle.LEVELS])
def test_manifest_equals_a_plain_tree(spark, levels):
    """Blocks of 8 leaves make three kinds of block above one another; nulls, repeats, ties, clashing names and odd bytes are rows like others."""
    rng = random.Random(levels)
    langs = [None, "", "en", "en", "en", "é", "-", "=", *[f"x{k}" for k in range(40)]]
    rows = [(rng.randrange(90), rng.choice(["a", "", None, "é\n:-"]), rng.choice(langs), rng.choice([None, "s", ""]), rng.choice([None, 0, 9, 99]), "n", 1) for _ in range(300)]
    rows += [(k, "long " * 1000, "en", "s", k, "n", 1) for k in range(100, 140)] + [rows[0]] * 9 + [(None, None, None, None, None, None, None)] * 2 + [(7, "t", "en", "s", 2**63 - 1, "n", 1)]
    got = merkle.verify(merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plain(rows)
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


def test_one_row_is_its_own_root_and_no_row_has_none(spark):
    row = merkle.manifest(spark.createDataFrame([(6, "t", "en", "s", 1, "n", 1)], SCHEMA)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == []
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], SCHEMA))).count() == 0
