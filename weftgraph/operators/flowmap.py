"""Flows through calls: where a body calls a name, and what an entry runs through, in the order of its code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.paths import common_folder
from weftgraph.operators.ranking import smallest_k
from weftgraph.session import cut

#: fixed values: bounds of a flow, words that open a block, and the order of kinds of flows
MOST_DEPTH, MOST_STEPS = 4, 40
OPENERS = {
    "if": ("if", "else", "elif", "unless", "guard"),
    "loop": ("for", "while", "loop", "do", "foreach"),
    "match": ("match", "switch", "case", "when", "select"),
    "try": ("try", "catch", "except", "finally", "rescue"),
}
KINDS = ("route", "main", "entry", "test")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: within lambdas Spark doesn't see that they are the same."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def block_kind(line: Column) -> Column:
    """What kind of block a line opens; null if none."""
    kinds = F.create_map(*[F.lit(x) for name, words in OPENERS.items() for word in words for x in (word, name)])

    def kind(bare: Column) -> Column:
        inline = F.when(bare.rlike(r"\.for(Each|_each)\("), "loop").when(bare.contains(" match ") & bare.endswith("{"), "match")
        return F.coalesce(F.try_element_at(kinds, F.regexp_extract(bare, r"^([\p{L}\p{N}_]*)", 1)), inline)

    return _let(F.regexp_replace(line, r"^\s*\}*\s*", ""), kind)


def indent(line: Column) -> Column:
    """Blanks before a line's text; a tab counts as four."""
    return _let(F.regexp_extract(line, r"^(\s*)", 1), lambda blanks: F.length(blanks) + 3 * (F.length(blanks) - F.length(F.replace(blanks, F.lit("\t")))))


def marks(body: Column) -> Column:
    """``at, kind, blank`` of each line: how far it is indented, what block it opens, and whether nothing stands there."""
    return F.transform(body, lambda line: F.struct(indent(line).alias("at"), block_kind(line).alias("kind"), (F.trim(line) == "").alias("blank")))


def calls_name(line: Column, name: Column) -> Column:
    """Whether a line calls a name: it stands alone, before ``(``, ``!(``, ``::<`` or ``<``."""
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E\s*(?:\(|!\(|::<|<)"))
    return F.when(name == "", False).otherwise(F.contains(line, name) & F.regexp_like(line, pattern))


def call_site(body: Column, first: Column, name: Column, marked: Column | None = None) -> Column:
    """``struct(site, branch)`` of the first line of ``body``, after its own first one, that calls a name; null if none does.

    ``body`` is an array of lines that starts at line ``first``. The branch is the kind of the innermost block around the
    call, told by indentation; a call on the line that opens a block is a condition. ``marked`` has the body's :func:`marks` where they are known.
    """
    numbered = F.transform(body, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    hit = F.get(F.filter(numbered, lambda x: (x["i"] > 0) & calls_name(x["line"], name)), F.lit(0))["i"]
    none = F.lit(None).cast("string").alias("kind")

    def found(i: Column, lines: Column) -> Column:
        above = F.reverse(F.slice(lines, 2, F.greatest(i - 1, F.lit(0))))
        start = F.struct(F.get(lines, i)["at"].alias("at"), none, F.lit(False).alias("done"), F.get(lines, F.lit(0))["at"].alias("base"))

        def step(s: Column, line: Column) -> Column:
            outer = line["at"] < s["at"]
            met = F.struct(F.when(outer, line["at"]).otherwise(s["at"]).alias("at"), F.when(outer, line["kind"]).alias("kind"), (outer & line["kind"].isNotNull()).alias("done"), s["base"].alias("base"))
            outside = F.struct(s["at"].alias("at"), none, F.lit(True).alias("done"), s["base"].alias("base"))
            return F.when(s["done"] | line["blank"], s).when(line["at"] <= s["base"], outside).otherwise(met)

        return F.when(i.isNotNull(), F.struct((first + i).alias("site"), F.aggregate(above, start, step, lambda s: s["kind"]).alias("branch")))

    return _let(hit, lambda i: _let(marks(body), lambda lines: found(i, lines)) if marked is None else found(i, marked))


def placed(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, name, tier, site, branch`` of ``src, dst, name, tier``; ``nodes`` has ``id, first, body``. Calls that no line shows have site 0.

    A node's lines are marked once, before its calls meet them.
    """
    at = call_site(F.col("body"), F.col("first"), F.col("name"), F.col("marks"))
    found = calls.join(nodes.select(F.col("id").alias("src"), "first", "body", marks(F.col("body")).alias("marks")), "src", "left").withColumn("at", at)
    return found.select("src", "dst", "name", "tier", F.coalesce("at.site", F.lit(0)).cast("long").alias("site"), F.col("at.branch").alias("branch"))


def entries(routes: DataFrame, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """``id, kind, route``: handlers of routes, functions named ``main``, and those with two calls or more that nothing calls.

    ``routes``: ``route, id``; ``nodes``: ``id, kind, name, test``; a node is the first of these that it can be.
    """
    handled = routes.groupBy("id").agg(F.min("route").alias("route")).select("id", F.lit(0).alias("rank"), "route")
    none = F.lit(None).cast("string").alias("route")
    main = nodes.where("kind = 'function' and name = 'main'").select("id", F.lit(1).alias("rank"), none)
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("id")
    free = nodes.where("kind in ('function', 'method')").join(out, "id", "left_semi").join(calls.select(F.col("dst").alias("id")), "id", "left_anti")
    free = free.select("id", F.when(F.col("test"), 3).otherwise(2).alias("rank"), none)
    best = handled.union(main).union(free).groupBy("id").agg(F.min(F.struct("rank", "route")).alias("m"))
    return best.select("id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("m.rank") + 1).alias("kind"), F.col("m.route").alias("route"))


def resumed(state: dict, answers: list[dict], depth: int, most: int) -> list[dict]:
    """Go on with a walk whose ``state`` holds ``done, stack, seen, pending``; gives the new steps in call order and leaves in ``ask`` what must be known next.

    A node counts once, where it is met first. The walk stops before the first node whose calls aren't known; those and the ones
    that wait behind it are asked for, as many as can still be met, and answers that aren't used yet stay pending.
    """
    pending = {n["id"]: n["kids"] for n in [*state["pending"], *answers]}
    seen, stack, steps = set(state["seen"]), state["stack"], []
    while stack and state["done"] < most:
        at = stack[-1]
        if at["id"] in seen:
            stack.pop()
            continue
        if at["depth"] < depth and at["id"] not in pending:
            break
        stack.pop()
        seen.add(at["id"])
        steps.append({"step": state["done"], **at})
        if at["depth"] < depth:
            stack += [{"id": kid, "depth": at["depth"] + 1, "parent": state["done"]} for kid in reversed(pending.pop(at["id"]))]
        state["done"] += 1
    over = not stack or state["done"] >= most
    waiting = dict.fromkeys(s["id"] for s in reversed(stack) if s["depth"] < depth and s["id"] not in seen and s["id"] not in pending)
    room = max(1, most - state["done"] - len(pending))
    state |= {"seen": sorted(seen), "pending": [{"id": k, "kids": v} for k, v in pending.items()], "ask": [] if over else list(waiting)[:room]}
    return steps


_STEP = pa.struct([("step", pa.int32()), ("id", pa.string()), ("depth", pa.int32()), ("parent", pa.int32())])
_KIDS = pa.struct([("id", pa.string()), ("kids", pa.list_(pa.string()))])
_STATE = pa.schema([
    ("entry", pa.string()), ("done", pa.int32()), ("stack", pa.list_(pa.struct([("id", pa.string()), ("depth", pa.int32()), ("parent", pa.int32())]))), ("seen", pa.list_(pa.string())),
    ("pending", pa.list_(_KIDS)), ("ask", pa.list_(pa.string())), ("steps", pa.list_(_STEP)),
])
_STATE_SQL = "entry string, done int, stack array<struct<id:string,depth:int,parent:int>>, seen array<string>, pending array<struct<id:string,kids:array<string>>>, ask array<string>, steps array<struct<step:int,id:string,depth:int,parent:int>>"


def unrolled(starts: DataFrame, calls: DataFrame, depth: int = MOST_DEPTH, most: int = MOST_STEPS) -> DataFrame:
    """``entry, step, id, depth, parent, site, branch, tier``: each start's calls depth first, in the order of the code.

    ``starts``: ``id``; ``calls`` as from :func:`placed`, one row a pair. Placed calls come by line, the others last, by name. A flow ends at
    ``most`` steps. Of a node's calls the first ``most`` are enough: when all of these were met, the flow is full. A walk is a state that
    each round goes on with: it reads the round's answers, at most ``most`` nodes a flow, writes its new steps and, unless it is over, its state, so what
    is written grows with the steps and no flow's surroundings are gathered whole.
    """
    ranked = smallest_k(calls.select("src", (F.col("site") == 0).alias("late"), "site", "name", "dst"), ["src"], ["late", "site", "name", "dst"], most)
    kids = cut(ranked.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("late", "site", "name", "dst"))), lambda k: k["dst"]).alias("kids")))

    def go_on(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = batch.to_pylist()
            for row in rows:
                row["steps"] = resumed(row, row.pop("answers"), depth, most)
            yield pa.RecordBatch.from_pylist(rows, _STATE)

    none = F.array().cast("array<string>")
    first = F.array(F.struct("id", F.lit(0).alias("depth"), F.lit(-1).alias("parent")))
    state = starts.where("id is not null").select("id").distinct()
    state = state.select(F.col("id").alias("entry"), F.lit(0).alias("done"), first.alias("stack"), none.alias("seen"), F.expr("cast(array() as array<struct<id:string,kids:array<string>>>)").alias("pending"), F.array("id").alias("ask"))
    parts = []
    for _ in range(most + 1):
        asked = state.select("entry", F.explode("ask").alias("id"))
        answers = asked.join(kids, "id", "left").groupBy("entry").agg(F.collect_list(F.struct("id", F.coalesce("kids", none).alias("kids"))).alias("answers"))  # at most ``most``
        state = cut(state.drop("ask").join(answers, "entry").mapInArrow(go_on, _STATE_SQL))
        parts.append(state.select("entry", F.inline("steps")))
        state = state.where(F.size("ask") > 0).drop("steps")
        if state.isEmpty():
            break
    steps = cut(reduce(DataFrame.unionByName, parts))
    before = steps.select("entry", F.col("step").alias("parent"), F.col("id").alias("src"))
    of = calls.select("src", F.col("dst").alias("id"), "site", "branch", "tier")
    return steps.join(before, ["entry", "parent"], "left").join(of, ["src", "id"], "left").select("entry", "step", "id", "depth", "parent", F.coalesce("site", F.lit(0)).alias("site"), "branch", "tier")


def flows(starts: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``entry, kind, route, domain, steps, files`` in order of kind, length and name; one step alone is a flow of routes only. ``nodes``: ``id, name, path, domain``."""
    sizes = steps.join(nodes.select("id", "path"), "id", "left").groupBy("entry").agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("path").alias("files"))
    found = starts.withColumnRenamed("id", "entry").join(sizes, "entry").join(nodes.select(F.col("id").alias("entry"), "name", "domain"), "entry", "left").where("steps > 1 or kind = 'route'")
    return found.orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.desc("steps"), "name").select("entry", "kind", "route", "domain", "steps", "files")


def domains(found: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``domain, label, flows, files`` of :func:`flows`; the label is the deepest folder that holds all of its files."""
    paths = steps.join(found.select("entry", "domain"), "entry").join(nodes.select("id", "path"), "id")
    files = paths.groupBy("domain").agg(common_folder(F.col("path")).alias("label"), F.count_distinct("path").alias("files"))
    return found.groupBy("domain").agg(F.count(F.lit(1)).alias("flows")).join(files, "domain").select("domain", "label", "flows", "files")
