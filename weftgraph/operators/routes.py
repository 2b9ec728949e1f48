"""Routes with placeholders, and which of them a concrete path belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAM = ":param"


def normalise(path: Column) -> Column:
    """Without query and empty segments; a segment in any placeholder notation becomes ``:param``."""
    parts = F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda s: (s != "") & (s != "**"))
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"^[:{<\[*]"), F.lit(PARAM)).otherwise(s)), "/"))


def _masked(segments: Column, mask: Column) -> Column:
    return F.zip_with(segments, mask, lambda s, free: F.when(free, F.lit("")).otherwise(s))


def match(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """``client, path, route_id`` (null if none): the equal route, else one whose placeholders fit; the last declared wins.

    ``clients`` has ``client, path``, ``routes`` has ``route_id, path, declared``, all paths normalised. Routes of one
    shape (which segments are placeholders) are looked up by equality on the other segments: a path is compared with
    shapes, of which there are few, and never with routes.
    """
    r = routes.withColumn("seg", F.split("path", "/")).withColumn("mask", F.transform("seg", lambda s: s == PARAM))
    r = r.select("mask", _masked(F.col("seg"), F.col("mask")).alias("key"), F.exists("mask", lambda m: m).alias("free"), "declared", "route_id")
    r = r.groupBy("mask", "key").agg(F.max(F.struct("declared", "route_id")).alias("r"), F.first("free").alias("free"))
    shapes = r.select("mask").distinct().withColumn("n", F.size("mask"))
    paths = clients.select("path").distinct().withColumn("seg", F.split("path", "/")).withColumn("n", F.size("seg"))
    tries = paths.join(shapes, "n").select("path", "mask", _masked(F.col("seg"), F.col("mask")).alias("key"))
    best = tries.join(r, ["mask", "key"]).groupBy("path").agg(F.max(F.struct((~F.col("free")).alias("exact"), "r.declared", "r.route_id")).alias("m"))
    return clients.join(best.select("path", "m.route_id"), "path", "left").select("client", "path", "route_id")
