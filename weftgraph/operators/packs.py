"""What to read first about a node, within a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import dealt, wide

#: tokens that an item costs besides its text, and the relevance of each relation
ITEM_TOKENS = 24
SEED, USES, USED_BY, CONTAINER, SECOND = ("seed", 1.0), ("uses", 0.72), ("used by", 0.6), ("container", 0.55), ("2nd-order", 0.34)
#: a row by its used node becomes several candidates, so rows are dealt into this many times as many parts by seed
FINER = 4
PACK = "seed string, id string, why string, position long, signature_only boolean, used long"


def tokens(chars: Column) -> Column:
    """An estimate: four characters a token, rounded up."""
    return F.ceil(chars / 4).cast("long")


def candidates(edges: DataFrame, tree: DataFrame, seeds: DataFrame, most_second: int = 6) -> DataFrame:
    """``seed, id, why, score`` around each seed (``seeds``: ``seed``); a node keeps its best relation.

    Each used node adds the ``most_second`` smallest ids that it uses itself. ``tree``: ``parent, child``.
    """
    arcs = edges.select("src", "dst")
    return around(arcs, arcs, arcs, tree, seeds, most_second)


def around(leaving: DataFrame, onward: DataFrame, entering: DataFrame, tree: DataFrame, seeds: DataFrame, most_second: int = 6, text: Callable[[str], Column] = F.col, parts: int | None = None) -> DataFrame:
    """``candidates`` of edges that may leave seeds, leave used nodes and enter seeds, each ``src, dst``; what doesn't is passed over.

    ``text`` tells what an id reads as, where ids are numbers. A used node brings its own few as one array, so an edge is shuffled
    by its used node and by its seed, in as many ``parts``, and candidates are made where they are told apart.
    """
    # a relation goes by its place, so that a row is two ids and a number until the best is known
    kinds = (SEED, USES, USED_BY, CONTAINER, SECOND)
    kind = lambda of: F.lit(kinds.index(of)).alias("kind")
    side = lambda df, key, parts=parts: wide(dealt(df, parts, key)) if parts else df
    few = dealt(onward.select(F.col("src").alias("used"), F.col("dst").alias("id")).where("used is not null"), parts, "used").distinct()
    at = F.row_number().over(Window.partitionBy("used").orderBy(text("id").asc_nulls_last()))
    nth = [F.max(F.when(F.col("at") == k + 1, F.col("id"))) for k in range(most_second)]
    few = few.withColumn("at", at).where(F.col("at") <= most_second).groupBy("used").agg(F.slice(F.array(*nth), F.lit(1), F.count(F.lit(1)).cast("int")).alias("few"))
    uses = side(leaving.select(F.col("src").alias("seed"), F.col("dst").alias("used")), "used").join(wide(few) if parts else few, "used", "left")

    rows = uses.select("seed", F.col("used").alias("id"), kind(USES), "few")
    for more, seed, node, why in ((entering, "dst", "src", USED_BY), (tree, "child", "parent", CONTAINER)):
        rows = rows.union(more.select(F.col(seed).alias("seed"), node, kind(why), F.lit(None).cast(few.schema["few"].dataType)))
    # a seed without rows stays, and each of its rows tells of it
    finer = parts and FINER * parts
    met = side(rows, "seed", finer).join(dealt(seeds.select("seed"), finer, "seed").distinct(), "seed", "right")
    item = lambda id_, no: F.struct(id_.alias("id"), no.alias("kind"))
    items = F.array(item(F.col("seed"), kind(SEED)), item(F.col("id"), F.col("kind")))
    second = F.transform(F.coalesce("few", F.array().cast(few.schema["few"].dataType)), lambda x: item(x, kind(SECOND)))
    found = met.select("seed", F.inline(F.filter(F.concat(items, second), lambda x: x["kind"].isNotNull())))
    best = found.groupBy("seed", "id").agg(F.min("kind").alias("kind"))
    of = lambda part: F.element_at(F.array(*[F.lit(k[part]) for k in kinds]), F.col("kind") + 1)
    return best.select("seed", "id", of(0).alias("why"), of(1).alias("score"))


def budget_pack(rows: DataFrame, budget: int, dealt_by_seed: bool = False) -> DataFrame:
    """The items of each seed's pack, taken greedily by score, then size, then id, while they fit.

    ``rows``: ``seed, id, why, score, span, cost, short``. What doesn't fit whole is taken as its
    signature (``short``), unless it is of second order; what doesn't fit either way is skipped and
    smaller ones may still follow, so this is no running sum. As an item that is refused means that
    all later ones of at least its least cost are, only the first ``budget / ITEM_TOKENS`` of each
    least cost can matter: the window drops the others, mostly before the shuffle; rows that are dealt by
    seed already aren't shuffled, and skip it. The rest is read in order, one counter per seed. An empty pack has no rows.
    """
    order = [F.desc("score"), F.asc_nulls_last("span"), F.asc_nulls_last("id")]
    least = F.when(F.col("why") == SECOND[0], F.col("cost")).otherwise(F.least("cost", "short"))
    rows = rows.withColumn("_least", least).where(F.col("_least") <= budget)
    if not dealt_by_seed:
        rank = F.row_number().over(Window.partitionBy("seed", "_least").orderBy(*order))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= budget // ITEM_TOKENS + 1)
    # the window asks that a seed's rows lie together in order, whether they are dealt already or not
    at = F.row_number().over(Window.partitionBy("seed").orderBy(*order))
    ordered = rows.select("seed", "id", "why", (F.col("why") == SECOND[0]).alias("late"), "cost", "short", at.alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, position = 0, 0
        for batch in batches:
            taken: list[int] = []
            out: list[tuple] = []
            for k, (late, cost, short, at) in enumerate(zip(*(batch[c].to_pylist() for c in ("late", "cost", "short", "at")), strict=True)):
                if at == 1:
                    used, position = 0, 0
                whole = cost is not None and used + cost <= budget  # what has no size is taken as its signature at most
                if not whole and (late or used + short > budget):
                    continue
                used, position = used + (cost if whole else short), position + 1
                taken.append(k)
                out.append((position, not whole, used))
            if out:
                own = batch.select(["seed", "id", "why"]).take(pa.array(taken))
                told = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, *told], [*own.schema.names, "position", "signature_only", "used"])

    return ordered.mapInArrow(run, PACK.replace("seed string", f"seed {dict(rows.dtypes)['seed']}"))
