"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import cut as cut
from weftgraph.session import read_table, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


table = read_table


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def session_conf(spark: SparkSession, **pairs: str):
    """Set SQL settings (``__`` stands for a dot) and put the old values back."""
    keys = {k.replace("__", "."): v for k, v in pairs.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(n)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many ``_`` behind it as set it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _bytes_of(field) -> Column:
    """Bytes of a value, 16 for what has a fixed width."""
    kind, col = field.dataType.typeName(), F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    return F.greatest(F.size(col), F.lit(0)) * 16 + 16 if kind == "array" else F.lit(16)


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to have few rows and bytes, else as it is.

    Meant for narrow tables of keys that are already cut; beyond the bounds the join shuffles.
    """
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0)).cast("long")
    rows, total = df.select(size.alias("b")).limit(most_rows + 1).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if rows <= most_rows and (total or 0) <= most_bytes else df


def filed(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and readers take the columns that they need."""
    path = fresh_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
