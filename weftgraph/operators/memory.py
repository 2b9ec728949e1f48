"""Notes tied to targets: recall, staleness, duplicates and the union of two copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(notes: DataFrame, near: DataFrame, words: list[str]) -> DataFrame:
    """``id, target, rank, hits`` of notes on a target or near it, or that hold a word asked for.

    ``notes``: ``id, target, body``; ``near``: ``target, rank`` (0 the target itself, then its file, callers and callees,
    the repository). Notes elsewhere have rank 4 and need a word. Order by rank, hits descending.
    """
    close = near.groupBy("target").agg(F.min("rank").alias("rank"))
    hay = F.lower(F.concat_ws(" ", "target", "body"))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.when(hay.contains(w.lower()), 1).otherwise(0)
    rows = notes.join(close, "target", "left").select("id", "target", F.coalesce("rank", F.lit(4)).alias("rank"), hits.alias("hits"))
    return rows.where("rank < 4 or hits > 0")


def stale(notes: DataFrame, bodies: DataFrame) -> DataFrame:
    """``id, stale``: the anchor isn't the hash of its target now, or the target is gone. ``bodies``: ``target, body_hash``."""
    rows = notes.join(bodies, "target", "left")
    return rows.select("id", (F.col("anchor").isNotNull() & ~F.col("anchor").eqNullSafe(F.col("body_hash"))).alias("stale"))


def dedupe(notes: DataFrame) -> DataFrame:
    """The first id of each target and body; bodies travel as digests, and equal digests are told apart by length."""
    return notes.groupBy("target", F.sha2("body", 256).alias("digest"), F.length("body").alias("n")).agg(F.min("id").alias("id")).select("target", "id")


def merge(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Union of two copies by ``id, created``; the later ``updated`` wins, mine among equals."""
    both = mine.withColumn("_mine", F.lit(1)).unionByName(theirs.withColumn("_mine", F.lit(0)))
    rest = [c for c in mine.columns if c not in ("id", "created")]
    best = both.groupBy("id", "created").agg(F.max_by(F.struct(*rest), F.struct("updated", "_mine")).alias("m"))
    return best.select("id", "created", *[F.col(f"m.{c}").alias(c) for c in rest])
