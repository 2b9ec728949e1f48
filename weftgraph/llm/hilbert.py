"""Sharding by Hilbert-curve order (operator 10); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import cut, spare

BITS = 4  # per dimension; 3 dimensions of 16 steps make 4096 cells
#: rows of a cell that are ranked together, and the most groups that all cells are salted into
GROUP_ROWS, MOST_GROUPS = 512, 1 << 16


def text_cuts(docs: DataFrame, columns: list[str], steps: int = 1 << BITS) -> dict[str, list[str]]:
    """For each column up to ``steps - 1`` of its values that cut the rows, in the order of whole values, into even parts.

    Values are counted, ranges of them are added up task by task, and the driver sees the cuts alone.
    Nulls count as empty texts.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])
    counts = docs.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("c", "part").agg(F.sum("n").alias("own"))  # one row a task and column
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("c", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy("c")).alias("total"))
    inside = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(parts), ["c", "part"]).withColumn("upto", F.col("upto") + F.col("base"))
    crossed = F.expr(f"upto * {steps} div total > (upto - n) * {steps} div total and upto < total")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in run.where(crossed).select("c", "v").collect():
        found[r["c"]].append(r["v"])
    return found


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell, by Skilling's transposed form, as one SQL fold.

    The state is ``(x, p, q, i)``; each of the ``(bits - 1) * n`` steps undoes one inversion or
    exchange, then Gray-encodes and interleaves.
    """
    n = len(coords)
    x = F.array(*[c.cast("long") for c in coords])
    steps = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("q"), F.lit(i).alias("i")) for k in range(bits - 1, 0, -1) for i in range(n)])

    def put(arr: Column, where: Column, value: Column) -> Column:
        return F.transform(arr, lambda v, j: F.when(j == where, value).otherwise(v))

    def undo(a: Column, s: Column) -> Column:
        p = s["q"] - 1
        first, own = F.element_at(a, 1), F.element_at(a, s["i"] + 1)
        t = first.bitwiseXOR(own).bitwiseAND(p)
        swapped = put(put(a, F.lit(0), first.bitwiseXOR(t)), s["i"], F.when(s["i"] == 0, first.bitwiseXOR(t)).otherwise(own.bitwiseXOR(t)))
        return F.when(own.bitwiseAND(s["q"]) != 0, put(a, F.lit(0), first.bitwiseXOR(p))).otherwise(F.when(s["i"] == 0, a).otherwise(swapped))

    turned = F.aggregate(steps, x, undo)
    gray = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(turned, F.lit(1), k), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(v)))
    last = F.element_at(gray, n)
    powers = F.array(*[F.lit(1 << k).cast("long") for k in range(bits - 1, 0, -1)])
    t = F.aggregate(powers, F.lit(0).cast("long"), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
    digits = [F.element_at(gray, i + 1).bitwiseXOR(t) for i in range(n)]
    out = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for d in digits:
            out = out * 2 + F.shiftright(d, k).bitwiseAND(F.lit(1).cast("long"))
    return out


def steps_above(value: Column, cuts: list) -> Column:
    """How many of the cuts lie below the value."""
    return sum((F.when(F.lit(c) < value, 1).otherwise(0) for c in cuts), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = 16, group_rows: int = GROUP_ROWS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """The columns of ``docs`` and ``size, text_crc32, law, shard, slot, grown_shard, hilbert`` for every row.

    Dimensions are source, language and size, each cut into up to 16 even steps, so that
    every shard covers a compact box and a reader prunes files on any of the three. Sources and languages are ordered by
    their whole values. Rows are ordered by (curve index, salt, doc_id, checksum); the run is cut so that counts differ by one at most.
    Ranks come from counts: a cell is salted into groups of about ``group_rows`` rows, or more where
    that would make over ``most_groups`` groups in all, so the table of counts is bounded whatever the input has. A null text has size 1; nulls in the
    other columns sort first; repeated ids get slots of their own; an empty table gives no rows.
    Columns of ``docs`` with one of the added names are replaced. ``docs`` is read three times, so it should
    come from files or be cut; who selects few of its columns shuffles no others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text).cast("long")
    cell = spare(docs, "_d0", "_d1", "_d2")
    salt, rank, own_size, own_crc, own_id, before, total, hilbert = spare(docs, "_salt", "_rank", "_size", "_crc", "_id", "_before", "_total", "_hilbert")
    cuts = text_cuts(docs, ["source", "lang"])
    parts = [(k + 1) / (1 << BITS) for k in range((1 << BITS) - 1)]
    sizes = sorted(set(docs.select(size.alias("s")).agg(F.percentile_approx("s", parts, 10000).alias("q")).first()["q"] or []))
    rows = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_size: size, own_crc: crc})
    for name, column, own_cuts in ((cell[0], F.coalesce(F.col("source").cast("string"), F.lit("")), cuts["source"]), (cell[1], F.coalesce(F.col("lang").cast("string"), F.lit("")), cuts["lang"]), (cell[2], F.col(own_size), sizes)):
        rows = rows.withColumn(name, steps_above(column, own_cuts))
    cells = cut(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")))  # at most 4096 rows
    share = F.ceil(F.col("n") * most_groups / F.sum("n").over(Window.partitionBy()))
    salts = F.broadcast(cut(cells.select(*cell, F.least(F.ceil(F.col("n") / group_rows), share).cast("int").alias(salt))))
    salted = rows.join(salts, cell).withColumn(salt, F.pmod(F.xxhash64(own_id, own_crc, own_size), F.col(salt)).cast("int"))
    counts = salted.groupBy(*cell, salt).agg(F.count(F.lit(1)).alias("count"))
    order = cut(counts.select(*cell, salt, "count", hilbert_index([F.col(d) for d in cell]).alias(hilbert)))
    ahead = Window.orderBy(hilbert, salt).rowsBetween(Window.unboundedPreceding, -1)
    # at most most_groups + 4096 rows, by construction: the one task that adds them up doesn't grow
    order = order.withColumn(before, F.coalesce(F.sum("count").over(ahead), F.lit(0))).withColumn(total, F.sum("count").over(Window.partitionBy())).drop("count")
    inside = Window.partitionBy(*cell, salt).orderBy(own_id, own_crc, own_size)
    ranked = salted.withColumn(rank, F.row_number().over(inside) - 1).join(F.broadcast(order), [*cell, salt])
    # rows are cut exactly, in whole numbers: shard s starts at ceil(s * total / shards)
    shard = F.expr(f"cast(({before} + {rank}) * {shards} div {total} as int)")
    start = F.expr(f"(({shards} - 1) + {total} * cast(({before} + {rank}) * {shards} div {total} as bigint)) div {shards}")
    added = {
        "size": F.col(own_size), "text_crc32": F.col(own_crc), "law": F.lit("rows"), "shard": shard, "slot": (F.col(before) + F.col(rank) - start).cast("long"),
        "grown_shard": F.lit(None).cast("int"), "hilbert": F.col(hilbert),
    }
    kept = [f"`{c}`" for c in docs.columns if c not in (*added, "doc_id")]
    return ranked.select(F.col(own_id).alias("doc_id"), *kept, *[c.alias(name) for name, c in added.items()])


def write_shards(docs: DataFrame, path: str, shards: int = 16, files: int = 64) -> None:
    """Write the rows of :func:`hilbert_shards` as Parquet, a folder ``shard=n`` for each shard.

    About ``files`` files in all are cut by ranges of shard and slot, so each holds neighbours on
    the curve, and the minima and maxima in its footer let a reader skip it.
    """
    placed = hilbert_shards(docs, shards)
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
