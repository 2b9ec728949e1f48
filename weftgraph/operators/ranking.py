"""Top-k of each key in two steps, so that one hot key doesn't sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 64


def smallest_k(rows: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first k rows of each key by ``order``, which should be total.

    Rows are cut to k within each of 64 hashed parts of a key first: at most 64 * k rows of a key meet.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = rows.withColumn("_salt", part).withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= k).drop("_r", "_salt")
    over = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("_r", F.row_number().over(over)).where(F.col("_r") <= k).drop("_r")
