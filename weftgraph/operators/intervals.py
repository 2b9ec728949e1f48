"""Joins on intervals and prefixes, each with an equality that bounds what meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: seconds of a bin of the time axis; a span is copied into each bin that it touches
BIN = 30 * 86_400


def _bin(at: Column, width: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")


def _binned(rows: DataFrame, a: str, b: str, width: int) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(_bin(F.least(a, b), width), _bin(F.greatest(a, b), width))))


def overlapping(spans: DataFrame, ranges: DataFrame, on: str, width: int = BIN) -> DataFrame:
    """``id, a, b, range_id`` of spans ``id, a, b`` that a range ``range_id, ra, rb`` of the same key touches.

    Both meet in the bins that they share, and a pair counts in the bin where the later of them begins, so each is
    found once. A key with very many spans is dealt by bins. A span or range with a null end is in no bin and touches nothing. A span that ends before it begins is touched by what holds both its ends.
    """
    both = _binned(spans, "a", "b", width).join(_binned(ranges, "ra", "rb", width), [on, "_bin"])
    here = _bin(F.greatest(F.least("a", "b"), F.least("ra", "rb")), width) == F.col("_bin")
    return both.where((F.col("ra") <= F.col("b")) & (F.col("rb") >= F.col("a")) & here).drop("_bin")


def innermost(points: DataFrame, spans: DataFrame, on: str, width: int = BIN) -> DataFrame:
    """For each ``point`` of a key the shortest span that holds it (ties: smallest id); null if none does.

    Points and spans of a key meet within a bin of the axis only.
    """
    hit = points.withColumn("_bin", _bin(F.col("point"), width)).join(_binned(spans, "a", "b", width), [on, "_bin"])
    hit = hit.where((F.col("a") <= F.col("point")) & (F.col("point") <= F.col("b")))
    length = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    best = hit.groupBy(on, "point").agg(F.min(F.struct(length.alias("len"), F.col("id").alias("owner"))).alias("m")).select(on, "point", "m.owner")
    return points.join(best, [on, "point"], "left")


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Each ``path`` with the longest module that is one of its leading folders; all prefixes are made, then joined by equality."""
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("module"))
    best = prefixes.join(modules.select("module").distinct(), "module").groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))
    return paths.join(best, "path", "left")


def overlapping_lines(spans: DataFrame, ranges: DataFrame, on: list[str], width: int = 256) -> DataFrame:
    """``spans`` (``first, last``) with each row of ``ranges`` (``ra, rb``) of the same keys that touches them, ends included.

    As :func:`overlapping`, on lines: a pair meets in the bins of ``width`` lines that both touch and counts in the one where the later begins. A span or
    range without an end, or that ends before it begins, touches nothing.
    """
    binned = lambda df, a, b: df.where(F.col(a) <= F.col(b)).withColumn("_bin", F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"{b} div {width}"))))
    both = binned(spans, "first", "last").join(binned(ranges, "ra", "rb"), [*on, "_bin"])
    return both.where((F.col("ra") <= F.col("last")) & (F.col("rb") >= F.col("first")) & (F.expr(f"greatest(first, ra) div {width}") == F.col("_bin"))).drop("_bin")
