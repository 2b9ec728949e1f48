"""Nearest neighbours by multiprobe p-stable hashing (operator 13).

Each table hashes a vector by ``HASHES`` projections on normal directions, cut in steps of one width: near vectors fall into
the same or a neighbouring step of each. A query visits its own bucket and those that moving one or more of its projections
to the next step leads to, in the order of the estimated chance of success: the sum of squared distances to the borders crossed
(Lv et al., 2007). Candidates of all tables are ranked by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import filed
from weftgraph.llm.vectors import matrix, meet, page_rows, salted, sampled, stored, usable

TABLES, HASHES, SEED = 4, 10, 11
#: share of the true neighbours within the sample that the fitted probes must reach, and the queries it is measured on
AIM, FIT_QUERIES = 0.98, 100
#: widths that are tried, in distances to the sample's neighbours, and numbers of probes
WIDTHS, PROBES = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0), (1, 3, 10, 30, 100, 200, 400, 800, 1600, 3000)


def perturbations(hashes: int, many: int) -> np.ndarray:
    """The ``many`` sets of places, among the 2 * ``hashes`` borders from the nearest on, with the least expected sum of squares.

    A row a set, filled up with the place behind the last; the first is empty. No set crosses both borders of one projection.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1, dtype=float)
    far = 2 * m + 1 - j
    square = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - far / (m + 1) + far * (far + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(square[0], (0,))]
    while heap and len(out) < many:
        score, places = heapq.heappop(heap)
        if len({min(p, 2 * m - 1 - p) for p in places}) == len(places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - square[last] + square[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (score + square[last + 1], (*places, last + 1)))
    return np.array([p + (2 * m,) * (max(map(len, out)) - len(p)) for p in out], np.int64).reshape(len(out), -1)


class Hashes:
    """The tables' directions, shifts and code factors: the same in every task, from ``SEED``."""

    def __init__(self, width: int, step: float, tables: int = TABLES, hashes: int = HASHES) -> None:
        rng = np.random.default_rng(SEED)
        self.step, self.tables, self.hashes = step, tables, hashes
        self.directions = rng.normal(size=(tables, width, hashes))
        self.shifts = rng.uniform(size=(tables, hashes))
        self.factors = rng.integers(-(2**62), 2**62, (tables, hashes))

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        # far beyond any step the code only has to be the same for the same vector
        return np.clip(x @ self.directions[table] / self.step + self.shifts[table], -(2.0**62), 2.0**62)

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row: its steps, mixed to one number."""
        return (np.floor(self.places(x, table)).astype(np.int64) * self.factors[table]).sum(axis=1)

    def probes(self, x: np.ndarray, table: int, sets: np.ndarray) -> np.ndarray:
        """The buckets that each row visits, likeliest first."""
        at = self.places(x, table)
        down = at - np.floor(at)
        border = np.concatenate([down, 1 - down], axis=1)
        move = np.concatenate([-self.factors[table], self.factors[table]])
        order = np.argsort(border, axis=1, kind="stable")
        none = np.zeros((len(x), 1))
        squares = np.concatenate([np.take_along_axis(border, order, 1) ** 2, none], axis=1)
        moves = np.concatenate([move[order], none.astype(np.int64)], axis=1)
        score, moved = squares[:, sets].sum(axis=2), moves[:, sets].sum(axis=2)
        return np.take_along_axis(self.codes(x, table)[:, None] + moved, np.argsort(score, axis=1, kind="stable"), 1)


def nearest(x: np.ndarray, k: int, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``queries`` rows' nearest others, and their distances."""
    out, far = [], []
    for a in range(min(queries, len(x))):
        d = ((x - x[a]) ** 2).sum(axis=1)
        d[a] = np.inf
        own = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        out.append(own)
        far.append(np.sqrt(d[own]))
    return np.array(out, np.int64).reshape(len(out), -1), np.array(far).reshape(len(out), -1)


def fitted(x: np.ndarray, k: int) -> tuple[float, int]:
    """The width of a step and the number of probes that reach ``AIM`` of the neighbours in a sample and see the fewest rows.

    Neighbours are no nearer in a sample than in the whole table, so the whole table's are reached as well. If nothing
    reaches the aim, what comes nearest is taken.
    """
    true, far = nearest(x, k, FIT_QUERIES)
    if not true.size:
        return 1.0, 1
    unit = float(np.quantile(far, 0.9)) or float(np.abs(x).max()) or 1.0
    sets, best = perturbations(HASHES, PROBES[-1]), None
    for share in WIDTHS:
        hashes = Hashes(x.shape[1], share * unit)
        ranks = np.full((len(true), len(x)), len(sets))
        for table in range(TABLES):
            codes, probes = hashes.codes(x, table), hashes.probes(x[: len(true)], table, sets)
            for a in range(len(true)):
                order = np.argsort(probes[a], kind="stable")
                place = np.minimum(np.searchsorted(probes[a], codes, sorter=order), len(sets) - 1)
                ranks[a] = np.where(probes[a][order[place]] == codes, np.minimum(ranks[a], order[place]), ranks[a])
        reached = np.take_along_axis(ranks, true, 1)
        for many in PROBES:
            recall, seen = float((reached < many).mean()), float((ranks < many).mean())
            choice = (min(recall, AIM), -seen)
            if best is None or choice > best[0]:
                best = (choice, share * unit, many)
    return best[1], best[2]


class Page:
    """Rows of some buckets, sorted by bucket."""

    def __init__(self, row: dict, width: int) -> None:
        self.ids, self.uids, codes = (np.frombuffer(row[c], np.int64) for c in ("ids", "uids", "codes"))
        self.rows = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
        self.codes, self.bucket = np.unique(codes, return_inverse=True)

    def ranked(self, q: np.ndarray, own: int, codes: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the ``k`` nearest rows within the buckets, or within all."""
        found = np.flatnonzero(self.ids != own if codes is None else np.isin(self.codes, codes)[self.bucket] & (self.ids != own))
        d = np.sqrt(((self.rows[found] - q) ** 2).sum(axis=1))
        if len(found) > k:  # those at the k-th distance all stay until ids decide
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            found, d = found[near], d[near]
        order = np.lexsort((self.uids[found], self.ids[found], d))[:k]
        return found[order], d[order]


def neighbours(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``rows`` with ``id, vector``: the ``k`` nearest found of each row whose id ``every`` divides.

    Nearness is Euclidean distance in doubles, ties by smaller id. Step width and probes are fitted on a bounded sample, every row is
    in every table, and parts of a table with many rows are cut by salts that a query visits all. A query that found fewer than ``k`` rows meets all
    rows, so only tables of fewer rows give fewer.

    Rows without id or vector, whose vector is zero, or with a component that is null or not finite, take no part. Rows that repeat
    an id all take part, but are no candidates of one another. Shorter vectors are filled up with zeros; no rows give none; extra columns don't matter.
    """
    positive = F.exists("vector", lambda x: x != 0)
    rows = rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where(F.col("id").isNotNull() & usable("vector") & positive)
    spark = rows.sparkSession
    rows, n, width = stored(rows, "vector")
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    step, probes = fitted(matrix(sampled(rows, n)["vector"], width), k)
    hashes, sets = Hashes(width, step), perturbations(HASHES, probes)
    most = page_rows(n)
    parts = -(-n // most)
    spread = lambda codes: (codes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["vector"], width)
            for table in range(TABLES):
                codes = hashes.codes(x, table)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "vector", "uid")), pa.array(codes), pa.array(table * parts + spread(codes))], ["id", "vector", "uid", "code", "part"])

    dealt = filed(rows.mapInArrow(deal, "id long, vector array<double>, uid long, code long, part long"), "buckets")
    placed, salts = salted(dealt, ["part"], most)
    many = {p: s for (p,), s in salts.items()}

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t["code"].to_numpy(), kind="stable")
        whole = {c: t[c].to_numpy()[order].astype(np.int64).tobytes() for c in ("id", "uid", "code")}
        return pa.table([t["page"][:1].combine_chunks(), *(pa.array([b], pa.binary()) for b in (whole["id"], whole["uid"], whole["code"], matrix(t["vector"], width)[order].tobytes()))], ["page", "ids", "uids", "codes", "vectors"])

    page = F.col("part") * (1 << 20) + F.col("salt")
    pages = filed(placed.withColumn("page", page).groupBy("page").applyInArrow(pack, "page long, ids binary, uids binary, codes binary, vectors binary"), "pages")
    queries = rows.where(F.col("id") % every == 0)
    count = queries.count()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each page that holds any of a query's buckets, with those."""
        for batch in batches:
            for a in range(0, batch.num_rows, 32):
                t = batch.slice(a, 32)
                x = matrix(t["vector"], width)
                for table in range(TABLES):
                    probed = hashes.probes(x, table, sets)
                    who, where, own = [], [], []
                    for q, codes in enumerate(probed):
                        part = table * parts + spread(codes)
                        order = np.argsort(part, kind="stable")
                        ends = np.flatnonzero(np.diff(part[order])) + 1
                        for g in np.split(order, ends):
                            for salt in range(many.get(int(part[g[0]]), 0)):
                                who.append(q)
                                where.append(int(part[g[0]]) * (1 << 20) + salt)
                                own.append(codes[g].tobytes())
                    took = t.take(pa.array(who, pa.int64()))
                    yield from pa.Table.from_arrays([*(took[c] for c in ("id", "vector", "uid")), pa.array(where, pa.int64()), pa.array(own, pa.binary())], ["id", "vector", "uid", "page", "probed"]).to_batches(max_chunksize=1000)

    def load(row: dict) -> Page:
        return Page(row, width)

    def answer(page: Page, t: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        probed = t["probed"].to_pylist()
        for a, (uid, own, q) in enumerate(zip(t["uid"].to_numpy(), t["id"].to_numpy(), matrix(t["vector"], width), strict=True)):
            found, d = page.ranked(q, own, None if probed[a] is None else np.frombuffer(probed[a], np.int64), k)
            for column, v in zip(out, (np.full(len(found), uid), page.uids[found], page.ids[found], d), strict=True):
                column.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query", "uid", "vec_id", "score"])

    asked = queries.mapInArrow(visits, "id long, vector array<double>, uid long, page long, probed binary")
    answers = "query long, uid long, vec_id long, score double"

    def best(found: DataFrame) -> DataFrame:
        found = found.dropDuplicates(["query", "uid"])  # a row that several tables found
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "uid"))).where(F.col("rank") <= k)

    found = filed(best(meet(pages, asked, count, load, answer, answers)), "found")
    full = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = filed(queries.join(full, queries["uid"] == full["query"], "left_anti"), "short")
    left = short.count()
    if left:
        # all pages of the first table, which holds every row once
        whole = pages.where(F.col("page") < parts * (1 << 20))
        names = spark.createDataFrame([(p * (1 << 20) + s,) for p, m in many.items() if p < parts for s in range(m)], "page long")
        everywhere = short.withColumn("page", F.explode(F.array_sort(F.lit([r["page"] for r in names.collect()])))).withColumn("probed", F.lit(None).cast("binary"))
        found = found.join(short.select(F.col("uid").alias("query")), "query", "left_anti").unionByName(best(meet(whole, everywhere, left, load, answer, answers)))
    named = queries.select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    return found.join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
