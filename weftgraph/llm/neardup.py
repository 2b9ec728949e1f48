"""MinHash near-deduplication verified with odd sketches (operator 7).

1. One pass over the texts makes, for each, a digest of its shingle set, 32 band keys of 4 MinHash
   samples and an odd sketch: 512 parity bits into which 128 samples are folded. Texts with the
   same set are one class, stood for by its smallest id; all that follows is on classes.
2. Each band bucket names its smallest member as its leader, and only pairs (leader, member) are
   made: as many rows as members, not pairs. Pairs whose sketches differ in too many bits go; the
   rest are verified on their full shingle sets, and links are joined to components.
3. Buckets whose other members still stand in several components are finished exactly: they are
   cut into blocks, and each pair of blocks is one group of ids, sketches and band keys. There every pair
   across components whose sketches are close meets once, in the first bucket that it shares; only ids of such pairs
   go on. Their texts are fetched, the pairs are compared on full sets block by block, and only links that join
   two components leave the task. So no candidate pair is lost and none but real links are rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, cut
from weftgraph.llm.components import connected_components
from weftgraph.llm.oddsketch import BANDS, band_keys, minhashes, most_xor, odd_sketches
from weftgraph.llm.textops import shingle_sets, text_slices

WIDTH = 5
#: members of a bucket that are compared with each other in one task at a time
BLOCK = 512
#: shingles that are counted in common at a time, as one matrix of members by shingles
STEP = 2048


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, digest, keys, sketch``; texts without words have nulls for the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, off in text_slices(batch.column(1)):
                values, bounds = shingle_sets(raw, off, width)
                sizes = np.diff(bounds)
                n, full = len(sizes), np.flatnonzero(sizes)
                digest, keys, sketch = [None] * n, [None] * n, [None] * n
                if len(full):
                    mins = minhashes(values, np.r_[bounds[full], len(values)])
                    k, s = band_keys(mins).view(np.int64), odd_sketches(mins)
                    for j, at in enumerate(full.tolist()):
                        digest[at] = hashlib.blake2b(values[bounds[at] : bounds[at + 1]].tobytes(), digest_size=16).digest()
                        keys[at], sketch[at] = k[j], s[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "keys", "sketch"],
                )

    schema = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _alike(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose full sets are alike."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last: tuple[str | None, np.ndarray] = (None, np.zeros(0))
            for i, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                sa, sb = ta.as_py() or "", tb.as_py() or ""
                if sa != last[0]:
                    last = sa, _set_of(sa, width)
                x, y = last[1], _set_of(sb, width)
                if len(x) and len(y) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    keep[i] = _alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a long, b long")


def _set_of(text: str, width: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), width)[0]


class _Block:
    """The two sides of a group of rows ``key, i, j, side, doc_id, label, sketch, keys``, each in order of ids."""

    def __init__(self, group: pa.Table) -> None:
        group = group.combine_chunks().sort_by([("side", "ascending"), ("doc_id", "ascending")])
        self.rows = group
        self.side, self.ids, self.labels = (group.column(c).to_numpy() for c in ("side", "doc_id", "label"))
        self.sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(self.ids), -1)
        self.keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        self.key = group.column("key")[0].as_py() if len(group) else 0
        self.a = np.flatnonzero(self.side == 0)
        self.b = np.flatnonzero(self.side == 1) if (self.side == 1).any() else self.a

    def open_pairs(self, limit: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(member, partners)``: pairs across components with close sketches whose first bucket in common is this one."""
        keys, sketch, labels = self.keys[self.b], self.sketch[self.b], self.labels[self.b]
        for p in self.a.tolist():
            near = (np.bitwise_count(sketch ^ self.sketch[p]).sum(1) <= limit) & (labels != self.labels[p])
            at = np.flatnonzero(near)
            if len(at):
                shared = keys[at] == self.keys[p]
                at = at[self.keys[p][shared.argmax(1)] == self.key]
            if len(at):
                yield p, self.b[at]


def open_members(group: pa.Table, limit: int) -> pa.Table:
    """The members of a group that have a pair to compare."""
    block = _Block(group)
    wanted = np.zeros(len(block.ids), bool)
    for p, partners in block.open_pairs(limit):
        wanted[p] = True
        wanted[partners] = True
    return block.rows.select(["key", "i", "j", "side", "doc_id", "label"]).filter(pa.array(wanted))


def joining_links(group: pa.Table, percent: int, limit: int, width: int = WIDTH) -> pa.Table:
    """Links between the two blocks of a group (or inside, if it is one) that join components; it has ``text`` too.

    Pairs of one component are skipped, as are those whose sketches differ in over ``limit`` bits and those
    that meet in an earlier bucket; the others meet on their full sets.
    """
    block = _Block(group)
    sets = [_set_of(t.as_py() or "", width) for t in block.rows.column("text")]
    size = np.array([len(s) for s in sets])
    a, b = block.a, block.b
    # common shingles: those that one text alone has can't be shared
    owner = np.repeat(np.arange(len(sets)), size)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    owner, column = owner[shared], number[inverse[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, STEP):
        s, e = np.searchsorted(column, [first, first + STEP])
        has = np.zeros((len(sets), STEP), np.float32)
        has[owner[s:e], column[s:e] - first] = 1
        common += has[a] @ has[b].T
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    ids, labels = block.ids, block.labels
    row, col = {p: k for k, p in enumerate(a.tolist())}, np.zeros(len(ids), np.int64)
    col[b] = np.arange(len(b))
    for p, partners in block.open_pairs(limit):
        hit = _alike(common[row[p]][col[partners]].astype(np.int64), size[p], size[partners], percent)
        for q in partners[hit].tolist():
            x, y = find(int(labels[p])), find(int(labels[q]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[p]), int(ids[q])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def near_links(reps: DataFrame, docs: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between classes that join all that are alike into components.

    ``reps`` has ``doc_id, keys, sketch``, one row per class; ``docs`` gives the texts.
    """
    limit = most_xor(percent / 100)
    members = reps.select("doc_id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = cut(members.join(buckets, "key").select("key", "doc_id", "leader", "n"))
    stars = crowd.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    bits = reps.select("doc_id", "sketch")
    both = stars.join(bits.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a").join(bits.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    close = cut(both.mapInArrow(_close(limit), "a long, b long"))

    wanted = broadcast_if_small(cut(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()), 500_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    links = cut(verified(close, texts, percent))
    roots = cut(connected_components(links))

    # what leaders didn't settle: buckets with three members or more, two of them in different components
    labels = crowd.where("n > 2 and doc_id <> leader").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    labels = labels.select("key", "doc_id", F.coalesce("root", "doc_id").alias("label"))
    mixed = labels.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
    mixed = broadcast_if_small(cut(mixed))
    # a member all of whose component in the bucket is settled still meets the others, so all of the bucket stay
    open_rows = cut(labels.join(mixed, "key"))
    if open_rows.isEmpty():
        return links
    parts = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    placed = open_rows.select("key", "doc_id", "label", parts.alias("parts"), mine.alias("mine"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("key", "doc_id", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rows = placed.join(reps.select("doc_id", "sketch", "keys"), "doc_id")
    group = ["key", "i", "j"]
    met = cut(rows.groupBy(*group).applyInArrow(lambda t: open_members(t, limit), "key long, i int, j int, side int, doc_id long, label long").distinct())
    if met.isEmpty():
        return links
    need = broadcast_if_small(cut(met.select("doc_id").distinct()), 500_000)
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(need, "doc_id", "left_semi")
    filled = met.join(bodies.join(reps.select("doc_id", "sketch", "keys"), "doc_id"), "doc_id")
    more = filled.groupBy(*group).applyInArrow(lambda t: joining_links(t, percent, limit), "a long, b long")
    return cut(links.union(more.distinct()))


def _close(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, a = batch.column(batch.schema.get_field_index("b")), batch.column(batch.schema.get_field_index("a"))
                x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                near = np.bitwise_count(x ^ y).sum(1) <= limit
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(near))

    return run


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked if 100 * |A & B| >= percent * |A | B| on their sets of 5-word shingles; the
    chance that banding misses a link of exactly this similarity is below 1e-9. The smallest id of
    a component is kept. Null, empty and wordless texts have no shingles and are linked with
    nothing. Rows with one id are one node: repeated rows share a component. A null id stands alone
    under a null component and is kept. An empty table gives no rows. Columns other than ``doc_id`` and ``text``
    are ignored, whatever their names. Of a very long text the words are held as numbers, some 25 bytes each.
    """
    rows = cut(signatures(docs))
    classes = cut(rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi").select("doc_id", "keys", "sketch")
    reps = cut(reps.groupBy("doc_id", "keys").agg(F.first("sketch").alias("sketch")))
    several = cut(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    repeats = not several.isEmpty()
    links = near_links(reps, docs.select("doc_id", "text").distinct() if repeats else docs, percent)
    if repeats:
        # an id with two texts is in two classes: the id joins them
        twice = rows.where("digest is not null").select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        links = links.union(twice.join(several.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b"))
    roots = connected_components(links)
    named = cut(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root")))
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of rows with one id one stays."""
    gone = broadcast_if_small(cut(near_dedup(docs, percent).where("not kept").select("doc_id").distinct()), 500_000)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
