"""The graph stated as triples, and the patterns that queries over them are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut, dealt


def state(edges: DataFrame, tree: DataFrame, once: bool = False, parts: int | None = None) -> DataFrame:
    """``s, p, o`` of calls and containment and of every node's kind, each once.

    Predicates tell the parts apart, so each is made distinct for itself; with ``once`` no pair stands twice in ``edges``, which then stay as they are.
    With ``parts`` nodes and containment are dealt into so many parts before they are made distinct.
    """
    called = edges.select("src", "dst")
    within = dealt(tree.select("parent", "child"), parts, "parent", "child").distinct()
    found = [(called if once else called.distinct()).select(F.col("src").alias("s"), F.lit("calls").alias("p"), F.col("dst").alias("o")), within.select("parent", F.lit("contains"), "child")]
    ids = reduce(DataFrame.union, [edges.select("src"), edges.select("dst"), tree.select("parent"), tree.select("child")]).toDF("s")
    ids = dealt(ids, parts, "s").distinct()
    found.append(ids.select("s", F.lit("a"), F.substring_index("s", ":", 1)))
    return reduce(DataFrame.union, found).toDF("s", "p", "o")


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """One triple pattern; ``?x`` binds a variable, anything else must be equal."""
    rows, names = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term in names:
            rows = rows.where(F.col(column) == F.col(names[term]))
        else:
            names[term] = column
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in names.items()])


def match(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """A basic graph pattern: joined on the variables shared; Catalyst orders the joins."""
    out = pattern(triples, *patterns[0])
    for p in patterns[1:]:
        right = pattern(triples, *p)
        shared = [c for c in right.columns if c in out.columns]
        if not shared:
            raise ValueError(f"pattern {p} shares no variable with those before it")
        out = out.join(right, shared)
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left")


def exists(left: DataFrame, right: DataFrame, wanted: bool = True) -> DataFrame:
    return left.join(right, _shared(left, right), "left_semi" if wanted else "left_anti")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Like ``exists(..., False)``, but solutions that share no variable are kept."""
    return left.join(right, shared, "left_anti") if (shared := [c for c in left.columns if c in right.columns]) else left


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both bags; a variable that one side lacks is unbound there."""
    return left.unionByName(right, allowMissingColumns=True)


def ask(solutions: DataFrame) -> DataFrame:
    """One row: is there a solution?"""
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct(solutions: DataFrame, *template: tuple[str, str, str]) -> DataFrame:
    """``s, p, o`` of a template for all solutions; triples with an unbound part go."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    rows = [solutions.select(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template]
    return reduce(DataFrame.union, rows).dropna().distinct()


def describe(triples: DataFrame, resource: str) -> DataFrame:
    return triples.where((F.col("s") == resource) | (F.col("o") == resource))


def path_plus(triples: DataFrame, predicate: str, starts: DataFrame, most_steps: int = 50) -> DataFrame:
    """``start, end`` of one or more steps along a predicate; set semantics. ``starts`` has ``start``.

    Each step joins what was new in the step before and is checkpointed.
    """
    arcs = cut(triples.where(F.col("p") == predicate).select(F.col("s").alias("at"), F.col("o").alias("end")).distinct())
    front = cut(starts.join(arcs, F.col("start") == F.col("at")).select("start", "end").distinct())
    seen = front
    for _ in range(most_steps):
        step = front.withColumnRenamed("end", "at").join(arcs, "at").select("start", "end").distinct()
        front = cut(step.join(seen, ["start", "end"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError(f"paths longer than {most_steps} steps: raise most_steps")


def percent(text: Column) -> Column:
    """Percent-encoded UTF-8, with ``/ @ + $ ! - . _ ~`` kept."""
    out = F.url_encode(text)  # keeps letters, digits and . _ - *; a space becomes +
    for written, meant in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%40", "@"), ("%2B", "+"), ("%24", "$"), ("%21", "!"), ("%7E", "~")):
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def n_triples(triples: DataFrame, base: str) -> DataFrame:
    """``line`` of each triple as N-Triples, all parts IRIs below ``base``."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), percent(F.col(c)), F.lit(">"))
    return triples.select(F.concat(F.concat_ws(" ", iri("s"), iri("p"), iri("o")), F.lit(" .")).alias("line"))


def turtle(triples: DataFrame, base: str) -> DataFrame:
    """``line`` of each triple, relative to ``base``; a file starts with ``@base <base> .``."""
    iri = lambda c: F.concat(F.lit("<"), percent(F.col(c)), F.lit(">"))
    return triples.select(F.concat(F.concat_ws(" ", iri("s"), iri("p"), iri("o")), F.lit(" .")).alias("line"))


def rdf_xml(triples: DataFrame, base: str) -> DataFrame:
    """``line`` of each triple, to stand in an ``rdf:RDF`` element with ``xmlns:g`` as ``base``; predicates must be names."""
    about = lambda c: F.concat(F.lit(f'"{base}'), percent(F.col(c)), F.lit('"'))
    head, middle = F.lit("<rdf:Description rdf:about="), F.concat(F.lit("><g:"), F.col("p"), F.lit(" rdf:resource="))
    return triples.select(F.concat(head, about("s"), middle, about("o"), F.lit("/></rdf:Description>")).alias("line"))


def json_ld(triples: DataFrame, base: str) -> DataFrame:
    """``line`` of each triple as a node object; percent-encoding leaves nothing to escape."""
    text = lambda c: F.concat(F.lit(f'"{base}'), percent(F.col(c)), F.lit('"'))
    return triples.select(F.concat(F.lit('{"@id":'), text("s"), F.lit(","), text("p"), F.lit(':{"@id":'), text("o"), F.lit("}}")).alias("line"))


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no variable is shared")
    return shared


def without(triples: DataFrame, hidden: DataFrame) -> DataFrame:
    """Triples of which neither subject nor object is among the hidden ``id``."""
    return triples.join(hidden.withColumnRenamed("id", "s"), "s", "left_anti").join(hidden.withColumnRenamed("id", "o"), "o", "left_anti").select("s", "p", "o")


def json_rows(solutions: DataFrame, limit: int) -> DataFrame:
    """``row, truncated``: at most ``limit`` solutions as JSON, the first by their text, and whether there were more."""
    rows = solutions.select(F.to_json(F.struct(*solutions.columns)).alias("row")).orderBy("row").limit(limit + 1)
    rows = cut(rows)
    more = rows.count() > limit
    return rows.orderBy("row").limit(limit).withColumn("truncated", F.lit(more))
