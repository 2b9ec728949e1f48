"""Hard negatives by inner product, searched in a packed R-tree (operator 11).

Rows are tiled by sort-tile-recursive packing on the label and the two coordinates that vary most: whole tables by cuts that a
sample gives, each tile by sorting. A page is a tile with leaves of ``LEAF`` rows; pages and leaves know their minimum bounding
boxes. For a query q the inner product with a box lies, coordinate by coordinate, between the products with its two sides,
and the sum of these intervals bounds the scores of all rows in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import filed
from weftgraph.llm.vectors import matrix, meet, page_rows, quantised, salted, sampled, stored, usable

LEAF = 64
NONE, LAST = -np.inf, np.iinfo(np.int64).max
#: sums of products below this are whole numbers in doubles, with the factor of 100 of the windows
EXACT = 2.0**46


def slabs(rows: int, size: int, levels: int) -> int:
    """How many slabs sort-tile-recursive packing cuts ``rows`` into, for tiles of ``size`` after ``levels`` cuts."""
    return max(1, int(np.ceil((rows / size) ** (1 / levels) - 1e-9)))


def tiled(keys: list[np.ndarray], size: int) -> np.ndarray:
    """The order of rows in which each run of ``size`` is a tile: sorted by the first key, cut in slabs, each sorted by the next."""

    def tile(rows: np.ndarray, level: int) -> np.ndarray:
        rows = rows[np.argsort(keys[level][rows], kind="stable")]
        if level + 1 == len(keys) or len(rows) <= size:
            return rows
        many = slabs(len(rows), size, len(keys) - level)
        step = -(-len(rows) // (many * size)) * size
        return np.concatenate([tile(rows[k : k + step], level + 1) for k in range(0, len(rows), step)])

    return tile(np.arange(len(keys[0])), 0)


def cuts(keys: list[np.ndarray], many: int) -> list:
    """Cuts into ``many`` slabs a level: for each level an array of cut values for each slab above."""
    inside = np.arange(1, many) / many
    pick = lambda v: np.quantile(v, inside, method="inverted_cdf") if len(v) else np.zeros(many - 1)
    out, groups = [], [np.arange(len(keys[0]))]
    for key in keys:
        own = [pick(key[g]) for g in groups]
        out.append(own)
        groups = [g[np.searchsorted(c, key[g], "right") == s] for g, c in zip(groups, own, strict=True) for s in range(many)]
    return out


def tile_of(keys: list[np.ndarray], levels: list, many: int) -> np.ndarray:
    at = np.zeros(len(keys[0]), np.int64)
    for key, own in zip(keys, levels, strict=True):
        inner = np.zeros(len(at), np.int64)
        for s in np.unique(at):
            inner[at == s] = np.searchsorted(own[s], key[at == s], "right")
        at = at * many + inner
    return at


def interval(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of each query with any point of each box."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


class Page:
    """Rows in the order of their leaves, and the leaves' boxes."""

    def __init__(self, row: dict, width: int) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.rows = quantised(np.frombuffer(row["vectors"], np.float64).reshape(-1, width))
        starts = np.arange(0, len(self.ids), LEAF)
        self.low, self.high = np.minimum.reduceat(self.rows, starts, axis=0), np.maximum.reduceat(self.rows, starts, axis=0)
        self.label_low, self.label_high = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)

    def exact(self, q: np.ndarray) -> np.ndarray:
        """The queries, and from now on the rows, as Python's integers if doubles could lose a digit."""
        if self.rows.dtype == object or q.dtype == object or np.abs(self.rows).max() * max(1.0, np.abs(q).max()) * q.shape[1] >= EXACT:
            self.rows, self.low, self.high = (np.vectorize(int, otypes=[object])(x) for x in (self.rows, self.low, self.high))
            return np.vectorize(int, otypes=[object])(q)
        return q


def holds(labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
    """Whether a box with these labels can hold a row of the query's label, or of another."""
    labels = labels[:, None]
    return (low <= labels) & (labels <= high) if same else ~((low == labels) & (high == labels))


def best_first(page: Page, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, bar: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``query, window, score, id`` of the first ``k`` rows in each score window ``low..high`` of each query.

    All queries go through their queues of leaves side by side, each from the leaf with the largest reach on. A leaf is out if its
    interval misses the windows or its reach is strictly below the k-th score so far or ``bar``, which other pages gave.
    """
    q = page.exact(q)
    kind, (many, windows) = q.dtype, low.shape
    least, most = interval(q, page.low, page.high)
    fits = holds(labels, page.label_low, page.label_high, same)
    reach = np.full((many, len(page.low), windows), NONE, kind)
    for w in range(windows):
        inside = fits & (most >= low[:, w, None]) & (least <= high[:, w, None])
        reach[:, :, w] = np.where(inside, np.minimum(most, high[:, w, None]), NONE)
    queue = np.argsort(-reach.max(axis=2), axis=1, kind="stable")
    tops, top_ids = np.full((many, windows, k), NONE, kind), np.full((many, windows, k), LAST)
    every = np.arange(many)
    for leaf in queue.T:
        own = reach[every, leaf]
        if not (own > NONE).any():
            break
        kth = np.maximum(tops[:, :, -1], bar)
        wanted = (own > NONE) & (own >= kth)
        for at in np.unique(leaf[wanted.any(axis=1)]):
            who, rows = np.flatnonzero((leaf == at) & wanted.any(axis=1)), slice(at * LEAF, (at + 1) * LEAF)
            scores = q[who] @ page.rows[rows].T
            right = ((page.labels[rows] == labels[who, None]) == same) & (page.ids[rows] != ids[who, None])
            for w in range(windows):
                found = right & wanted[who, w, None] & (scores >= np.maximum(low[who, w, None], kth[who, w, None])) & (scores <= high[who, w, None])
                some = found.any(axis=1)
                if some.any():
                    to = who[some]
                    s = np.concatenate([tops[to, w], np.where(found[some], scores[some], NONE)], axis=1)
                    i = np.concatenate([top_ids[to, w], np.where(found[some], page.ids[rows], LAST)], axis=1)
                    first = np.argsort(i, axis=1, kind="stable")
                    s, i = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
                    first = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    tops[to, w], top_ids[to, w] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    for a, w, r in zip(*np.nonzero(tops > NONE), strict=True):
        yield int(a), int(w), int(tops[a, w, r]), int(top_ids[a, w, r])


def _long(v: int) -> int:
    return max(-LAST - 1, min(LAST, v))


def packed(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the ``page`` of each, and the pages: their rows leaf by leaf, box and labels."""
    most = page_rows(n)
    sample = sampled(rows, n)
    vary = np.argsort(-matrix(sample["vector"], width).var(axis=0), kind="stable")[:2]

    def keys(t: pa.Table) -> list[np.ndarray]:
        x = matrix(t["vector"], width)
        return [t["label"].to_numpy().astype(np.float64), *(x[:, v] for v in vary)]

    many = slabs(n, most, 1 + len(vary))
    levels = cuts(keys(sample), many)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            yield from t.append_column("tile", pa.array(tile_of(keys(t), levels, many))).to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    # a tile of many equal values is cut by salts
    placed, _ = salted(rows.mapInArrow(deal, f"{fields}, tile long"), ["tile"], most)
    placed = filed(placed.withColumn("page", F.col("tile") * (1 << 32) + F.col("salt")).drop("tile", "salt"), "tiles")

    def pack(t: pa.Table) -> pa.Table:
        x, order = matrix(t["vector"], width), tiled(keys(t), LEAF)
        ids, labels, whole = (t[c].to_numpy()[order].astype(np.int64) for c in ("id", "label", "page"))
        q = quantised(x)
        low, high = (np.array(v, np.float64).tolist() for v in (q.min(axis=0), q.max(axis=0)))
        return pa.table({
            "page": pa.array(whole[:1]), "ids": pa.array([ids.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()), "vectors": pa.array([x[order].tobytes()], pa.binary()),
            "low": pa.array([low]), "high": pa.array([high]), "label_low": pa.array([labels.min()]), "label_high": pa.array([labels.max()]),
        })

    schema = "page long, ids binary, labels binary, vectors binary, low array<double>, high array<double>, label_low long, label_high long"
    return placed, filed(placed.groupBy("page").applyInArrow(pack, schema), "pages")


def windows_of(scores: list[list[int]], percent: tuple[int, int], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole scores s with ``percent[0] * p <= 100 * s <= percent[1] * p`` for each positive score p, as two arrays; empty where there is none."""
    low, high = np.full((len(scores), wide), np.inf, object), np.full((len(scores), wide), -np.inf, object)
    for a, own in enumerate(scores):
        for w, p in enumerate(own):
            low[a, w], high[a, w] = -(-percent[0] * p // 100), percent[1] * p // 100
    fine = all(abs(v) < EXACT or v in (np.inf, -np.inf) for v in (*low.ravel(), *high.ravel()))
    return (low.astype(np.float64), high.astype(np.float64)) if fine else (low, high)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` with ``id, label, vector``.

    Anchors are rows whose id ``every`` divides. A row's score is the inner product of floor(256 * x) with the anchor's; higher first, ties by smaller id.
    Each anchor's first ``positives`` other rows of its label are its positives, and for each of these the first
    ``negatives`` rows of other labels with a score between the two shares of the positive's are returned.
    Anchors meet the page they are in first; its k-th score and the boxes tell which other pages can matter.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Rows that repeat an id
    all take part, but are no other rows of one another. Shorter vectors are filled up with zeros; scores beyond a long count as its ends; no
    rows give none. Extra columns don't matter. The driver sees a sample of bounded size and the boxes of at most some 20,000 pages.
    """
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    rows, n, width = stored(rows, "vector")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    placed, pages = packed(rows, n, width)
    anchors = placed.where(F.col("id") % every == 0)
    count = anchors.count()
    boxes = pages.select("page", "low", "high", "label_low", "label_high").toArrow()
    low, high = matrix(boxes["low"], width), matrix(boxes["high"], width)
    names, label_low, label_high = (boxes[c].to_numpy() for c in ("page", "label_low", "label_high"))

    def load(row: dict) -> Page:
        return Page(row, width)

    def visits(queries: DataFrame, decide) -> DataFrame:
        """Each query for each page that ``decide(least, most, batch)`` says it must see."""
        out = [f for f in queries.schema.fields if f.name != "page"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 128):
                    t = pa.Table.from_batches([batch.slice(k, 128)])
                    q = quantised(matrix(t["vector"], width)).astype(np.float64)
                    # room for rounding; a box that is let in by it changes no result
                    room = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
                    least, most = interval(q, low, high)
                    who, where = np.nonzero(decide(least - room, most + room, t))
                    part = t.select([f.name for f in out]).take(pa.array(who))
                    yield from part.append_column("page", pa.array(names[where])).to_batches(max_chunksize=1000)

        return queries.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", page long")

    def near(page: Page, t: pa.Table) -> pa.Table:
        free = np.full((len(t), 1), np.inf)
        bar = np.array([NONE if b is None else b for b in t["bar"].to_pylist()])[:, None]
        found = list(best_first(page, quantised(matrix(t["vector"], width)), t["id"].to_numpy(), t["label"].to_numpy(), -free, free, positives, True, bar))
        uid = t["uid"].to_numpy()
        return pa.table([pa.array([uid[a] for a, _, _, _ in found], pa.int64()), pa.array([_long(s) for _, _, s, _ in found], pa.int64()), pa.array([i for *_, i in found], pa.int64())], ["uid", "score", "other"])

    own = anchors.select("page", "uid", "id", "label", "vector")
    home = filed(meet(pages, own.withColumn("bar", F.lit(None).cast("long")), count, load, near, "uid long, score long, other long"), "home")
    bars = home.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("bar"))
    # page of its own: it has been met
    waiting = own.withColumnRenamed("page", "met").join(bars, "uid", "left")

    def better(least: np.ndarray, most: np.ndarray, t: pa.Table) -> np.ndarray:
        bar = np.array([NONE if b is None else b for b in t["bar"].to_pylist()])[:, None]
        return holds(t["label"].to_numpy(), label_low, label_high, True) & (most >= bar) & (names != t["met"].to_numpy()[:, None])

    rest = meet(pages, visits(waiting, better).drop("met"), count, load, near, "uid long, score long, other long")
    ranked = home.unionByName(rest).withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "other"))).where(F.col("k") <= positives)
    found = ranked.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "score", "other"))).alias("p"))  # at most ``positives`` each
    asked = filed(own.drop("page").join(found.select("uid", F.col("p.score").alias("scores"), F.col("p.other").alias("others")), "uid"), "positives")

    def inside(least: np.ndarray, most: np.ndarray, t: pa.Table) -> np.ndarray:
        a, b = (x.astype(np.float64) for x in windows_of(t["scores"].to_pylist(), percent, positives))
        hit = ((most[:, :, None] >= a[:, None]) & (least[:, :, None] <= b[:, None]) & (a <= b)[:, None]).any(axis=2)
        return holds(t["label"].to_numpy(), label_low, label_high, False) & hit

    def far(page: Page, t: pa.Table) -> pa.Table:
        scores, others = t["scores"].to_pylist(), t["others"].to_pylist()
        a, b = windows_of(scores, percent, positives)
        found = list(best_first(page, quantised(matrix(t["vector"], width)), t["id"].to_numpy(), t["label"].to_numpy(), a, b, negatives, False, np.full(a.shape, NONE)))
        uid, ids = t["uid"].to_pylist(), t["id"].to_pylist()
        made = [(uid[q], ids[q], w, others[q][w], scores[q][w], _long(s), i) for q, w, s, i in found]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [[]] * 7)], ["uid", "anchor_id", "w", "positive_id", "positive_score", "negative_score", "negative_id"])

    schema = "uid long, anchor_id long, w long, positive_id long, positive_score long, negative_score long, negative_id long"
    all_found = meet(pages, visits(asked, inside), count, load, far, schema)
    order = Window.partitionBy("uid", "w").orderBy(F.desc("negative_score"), "negative_id")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled(embeddings: DataFrame) -> DataFrame:
    """The rows of ``embeddings`` with every seventh label moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
