"""What logs and ledgers keep when they grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranking import smallest_k


def retain_log(rows: DataFrame, order: str, size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """All rows of a log below ``most_bytes`` or with at most ``most_rows``; else the newest half of ``most_rows``."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    small = total["bytes"] < most_bytes or total["n"] <= most_rows
    return rows if small else rows.orderBy(F.desc(order)).limit(most_rows // 2)


def newest(rows: DataFrame, key: str, order: str, n: int = 200) -> DataFrame:
    """The newest n rows of each key."""
    return smallest_k(rows, [key], [F.desc(order)], n)


def prune_rejected(trials: DataFrame, key: str, order: str, kept: Column, rejected: int = 10) -> DataFrame:
    """All kept trials, and of each key's rejected ones the oldest ``rejected``; unknown counts as rejected."""
    kept = F.coalesce(kept, F.lit(False))
    return trials.where(kept).unionByName(smallest_k(trials.where(~kept), [key], [order], rejected))
