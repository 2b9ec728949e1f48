"""Stable keys, labels and identifiers of nodes that share a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The class of a node by its kind.
CLASSES = {
    "function": "Function", "method": "Method", "class": "Class", "interface": "Interface", "file": "File", "package": "Package",
    "dependency": "Dependency", "route": "Route", "env": "Env", "table": "Table",
}


def nth(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds ``nth``, the place of a row among those of its key, from 1."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def stable_keys(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``stable``: the key, and ``#2``, ``#3`` ... behind its repeats in build order."""
    return nth(rows, [key], order).withColumn("stable", F.when(F.col("nth") > 1, F.concat_ws("#", key, F.col("nth").cast("string"))).otherwise(F.col(key))).drop("nth")


def entity_iris(rows: DataFrame, base: str, line: str, order: list[str]) -> DataFrame:
    """Adds ``iri``: the first of a base keeps it, later ones get ``~`` and their line."""
    return nth(rows, [base], order).withColumn("iri", F.when(F.col("nth") > 1, F.concat_ws("~", base, F.col(line).cast("string"))).otherwise(F.col(base))).drop("nth")


def unique_labels(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Adds ``label_``: the first of a label keeps it, later ones get a blank and their number."""
    return nth(rows, [label], order).withColumn("unique_label", F.when(F.col("nth") > 1, F.concat_ws(" ", label, F.col("nth").cast("string"))).otherwise(F.col(label))).drop("nth")


def class_of(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    return F.coalesce(known[kind], F.lit("Symbol"))


def date_time(seconds: Column) -> Column:
    """Seconds since 1970 as an XML dateTime in UTC, whatever the session's zone is."""
    return F.concat(F.date_format(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
