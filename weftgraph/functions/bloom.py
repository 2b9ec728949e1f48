"""A Bloom filter of a column's values, tested within column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES, BITS_EACH, LEAST_BITS, MOST_BITS = 5, 12, 1 << 10, 1 << 23


def _bits(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def bloom_filter(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is true for all values of the column and for few others; null is none.

    12 bits for each distinct value, 1 MB at most: with more than some 700,000 values it lets more pass, and never
    loses one. The filter is one row that is read where it is tested; it meets no join.
    """
    known = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * known.count()):
        bits *= 2
    words = known.select(F.explode(F.array(*_bits(F.col("v"), bits))).alias("b")).groupBy(F.expr("b div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits"))
    every = values.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))  # at most 131,072 words
    table = row.select(F.col("all.bits").alias("bits")).scalar()

    def test(value: Column) -> Column:
        one = lambda b: F.call_function("shiftrightunsigned", F.element_at(table, (F.floor(b / 64) + 1).cast("int")), (b % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        return functools.reduce(lambda a, b: a & b, (one(b) for b in _bits(value, bits))) & value.isNotNull()

    return test
