"""Checks on a change before it is let in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import policy, traversal

RISKS = ("none", "low", "medium", "high")


def blast(edges: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """``id, depth`` of all that depends on ``changed`` (``id``), these themselves left out."""
    hits = traversal.impact(edges, changed.select(F.lit("all").alias("seed"), "id"), True, max_depth)
    return hits.select("id", "depth").join(changed, "id", "left_anti")


def reach_beyond(actual: DataFrame, expected: DataFrame, scopes: list[str]) -> DataFrame:
    """The ``path`` of ``actual`` that is neither expected nor in scope."""
    return actual.select("path").distinct().join(expected.select("path"), "path", "left_anti").where(~policy.in_scope(F.col("path"), scopes))


def new_loops(now: DataFrame, before: DataFrame) -> DataFrame:
    """The two-way loops (``a, b``, a < b) that were not there before."""
    return now.select("a", "b").distinct().join(before.select("a", "b"), ["a", "b"], "left_anti")


def report(change: DataFrame, deps: DataFrame, verdicts: DataFrame, max_risk: str) -> DataFrame:
    """``name, value, passed`` of three checks: risk of the change, undeclared dependencies, locked nodes touched.

    ``change`` has one row with ``risk``; ``deps`` has ``state``; ``verdicts`` has ``level`` of what was touched.
    """
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    risk = change.select(F.lit("risk").alias("name"), F.col("risk").alias("value"), (rank <= RISKS.index(max_risk) + 1).alias("passed"))
    count = lambda df, name, bad: df.agg(F.count_if(bad).alias("n")).select(F.lit(name).alias("name"), F.col("n").cast("string").alias("value"), (F.col("n") == 0).alias("passed"))
    return risk.unionByName(count(deps, "undeclared", F.col("state") == "undeclared")).unionByName(count(verdicts, "locked", F.col("level") >= policy.LOCKED))
