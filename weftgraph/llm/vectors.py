"""Vector columns as matrices, and pages of vectors that answer streams of queries (operators 11 and 13)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import filed

#: the least and most rows of a page, and about how many pages a small table has, so that all tasks have work
LEAST_ROWS, MOST_ROWS, SPREAD = 256, 32_768, 32
#: pages of a larger table than ``MOST_ROWS * MOST_PAGES`` hold more rows, so that what the driver knows of pages is bounded
MOST_PAGES = 20_000
#: queries that one task holds against one page; more make copies of the page
PAGE_QUERIES = 16_384
#: rows on which cuts and widths are fitted, about
SAMPLE_ROWS = 20_000


def usable(vector: str) -> Column:
    """No null, and no component that is null or not finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def page_rows(rows: int) -> int:
    return max(LEAST_ROWS, min(MOST_ROWS, rows // SPREAD), -(-rows // MOST_PAGES))


def stored(rows: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """``rows`` with a number ``uid`` of each, written once; how many, and the length of the longest ``vector``."""
    rows = filed(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    return rows, n, max(1, width or 1)


def sampled(rows: DataFrame, n: int) -> pa.Table:
    """About ``SAMPLE_ROWS`` rows, by a hash of their numbers, and never over twice that."""
    return rows.where(F.pmod(F.xxhash64("uid"), F.lit(-(-n // SAMPLE_ROWS) or 1)) == 0).limit(2 * SAMPLE_ROWS).orderBy("uid").toArrow()


def salted(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, dict[tuple, int]]:
    """``rows`` with a ``salt`` that cuts each key's rows into parts of about ``most``, and each key's number of parts.

    Keys are few (at most about :data:`MOST_PAGES` of a fit), so the driver knows their counts.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    known = counts.collect()
    session = rows.sparkSession
    table = F.broadcast(session.createDataFrame(known, counts.schema))
    out = rows.join(table, keys).withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int")).drop("salts")
    return out, {tuple(r[:-1]): r[-1] for r in known}


def meet(pages: DataFrame, visits: DataFrame, queries: int, load: Callable[[dict], object], answer: Callable[[object, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``answer(load(page), visits of it)`` gives for every ``page`` that both tables name.

    A task reads a page, one row, and then its visits batch by batch, so memory is bounded by a page and a batch however many
    visits a page has. Of ``queries`` over :data:`PAGE_QUERIES`, each copy of the page gets a part.
    """
    copies = -(-queries // PAGE_QUERIES) or 1
    pages = pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("kind", F.lit(0))
    visits = visits.withColumn("copy", F.pmod(F.xxhash64("uid"), F.lit(copies)).cast("int")).withColumn("kind", F.lit(1))
    own = pages.columns
    both = pages.unionByName(visits, allowMissingColumns=True).repartition("page", "copy").sortWithinPartitions("page", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            page, copy, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("page", "copy", "kind"))
            ends = np.flatnonzero((np.diff(page) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *ends], [*ends, len(page)], strict=True):
                if a == b:
                    continue
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if kind[a] == 0:
                    at, held = (page[a], copy[a]), load({c: part[c][0].as_py() for c in own})
                elif at == (page[a], copy[a]):
                    yield from answer(held, part).to_batches()

    return both.mapInArrow(run, schema)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles where these are whole numbers without loss, else as Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(256.0 * x)
    if not y.size or np.abs(y).max() < 2**53:
        return y
    return np.array([int(v) * 256 if abs(v) >= 2**53 else math.floor(256 * v) for v in x.ravel().tolist()], object).reshape(x.shape)
