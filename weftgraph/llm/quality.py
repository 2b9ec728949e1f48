"""Document quality by attention-based multiple-instance learning (operator 6).

A document is a bag of passages. Each passage is encoded (hashed words and character classes
through a trained tanh layer), a gated attention weighs the passages, and a logistic unit scores the
weighted sum. Only document labels are used, so the attention learns which passages tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import crc_mod, cut
from weftgraph.llm.textops import text_slices, word_hashes

_U = np.uint64
PASSAGE_WORDS, HASHED, EXTRA = 96, 64, 12
FEATURES = HASHED + EXTRA
#: labelled documents that the model is fitted on, and bytes of their texts, at most; all passages of these are used
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 4000, 64 << 20
#: passages whose letters are counted at a time
RUN = 256

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_CLASSES = np.zeros((256, 6), np.float32)
_CLASSES[65:91, 0] = 1  # upper
_CLASSES[97:123, 1] = 1  # lower
_CLASSES[48:58, 2] = 1  # digit
_CLASSES[128:, 3] = 1  # beyond ASCII
_CLASSES[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63], 4] = 1  # marks of prose
_CLASSES[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126], 5] = 1  # other marks


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the passages of every text and each text's bounds; a text has one at least.

    Letters are counted ``RUN`` passages at a time, so a very long text takes some 30 bytes of memory a word.
    """
    rows: list[np.ndarray] = []
    bounds = [0]
    inside = _SOLID[raw]
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text, solid = raw[s:e], inside[s:e]
        words, _ = word_hashes(text, np.array([0, e - s]))
        if not len(words):
            rows.append(np.zeros((1, FEATURES), np.float32))
            bounds.append(bounds[-1] + 1)
            continue
        starts = np.flatnonzero(np.diff(solid, prepend=False) & solid)
        cuts = np.arange(0, len(words), PASSAGE_WORDS)
        if len(cuts) > 1 and len(words) - cuts[-1] < PASSAGE_WORDS // 4:
            cuts = cuts[:-1]  # a short rest belongs to the passage before it
        n = len(cuts)
        out = np.zeros((n, FEATURES), np.float32)
        sizes = np.diff(np.r_[cuts, len(words)])
        owner = np.repeat(np.arange(n), sizes)
        slot = (words >> _U(40)).astype(np.int64) % HASHED
        out[:, :HASHED] = np.sqrt(np.bincount(owner * HASHED + slot, minlength=n * HASHED).reshape(n, HASHED) / sizes[:, None])
        at = starts[cuts]
        ends = np.r_[at[1:], len(text)]
        sums = np.concatenate([np.add.reduceat(_CLASSES[text[at[k] : ends[min(n, k + RUN) - 1]]], at[k : k + RUN] - at[k], axis=0) for k in range(0, n, RUN)])
        length = np.diff(np.r_[at, len(text)])[:, None]
        out[:, HASHED : HASHED + 6] = np.sqrt(sums / length)
        order = np.lexsort((words, owner))
        fresh = np.r_[True, (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
        out[:, HASHED + 6] = np.bincount(owner[order], weights=fresh, minlength=n) / sizes
        same = np.r_[False, words[1:] == words[:-1]]
        out[:, HASHED + 7] = np.bincount(owner, weights=same, minlength=n) / sizes
        out[:, HASHED + 8] = np.minimum(length[:, 0] / sizes / 12, 2)
        out[:, HASHED + 9] = len(np.unique(words)) / len(words)
        out[:, HASHED + 10] = np.log1p(len(words)) / 10
        out[:, HASHED + 11] = np.bincount(owner, weights=np.isin(words, words[-1:]), minlength=n) / sizes
        rows.append(out)
        bounds.append(bounds[-1] + n)
    return np.concatenate(rows) if rows else np.zeros((0, FEATURES), np.float32), np.array(bounds)


@dataclass
class BagModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def attend(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags and attention weights of their passages."""
        score, attention, _ = _forward(self.weights, (x - self.mean) / self.spread, bounds)
        return score, attention


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray):
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    logit = (t * g) @ w["a"]
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    top = np.maximum.reduceat(logit, bounds[:-1])
    p = np.exp(logit - top[bag])
    p /= np.add.reduceat(p, bounds[:-1])[bag]
    z = np.add.reduceat(p[:, None] * h, bounds[:-1], axis=0)
    score = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))
    return score, p, (h, t, g, bag, z)


def fit_bags(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 30, batch: int = 64, seed: int = 5) -> BagModel:
    """Adam on the cross-entropy of the bags; both labels keep their share, so scores are chances."""
    mean, spread = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / spread
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    w = {
        "E": rng.normal(0, f**-0.5, (f, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "o": rng.normal(0, hidden**-0.5, hidden), "b": np.zeros(1),
    }
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step = 0
    for epoch in range(rounds):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            bags = order[s : s + batch]
            idx = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in bags])
            bb = np.r_[0, np.cumsum(bounds[bags + 1] - bounds[bags])]
            xi = x[idx]
            score, p, (h, t, g, bag, z) = _forward(w, xi, bb)
            d = (score - y[bags]) / len(bags)
            dz = d[:, None] * w["o"]
            dh = p[:, None] * dz[bag]
            dp = (dz[bag] * h).sum(1)
            dl = p * (dp - np.add.reduceat(p * dp, bb[:-1])[bag])
            dt, dg = dl[:, None] * w["a"] * g * (1 - t * t), dl[:, None] * w["a"] * t * g * (1 - g)
            dh += dt @ w["V"].T + dg @ w["U"].T
            du = dh * (1 - h * h)
            grad = {"E": xi.T @ du, "e": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ dl, "o": z.T @ d, "b": d.sum(keepdims=True)}
            step += 1
            rate = 0.004 * (1 - 0.9 * epoch / rounds)
            for k in w:
                gk = grad[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return BagModel(mean.astype(np.float32), spread.astype(np.float32), {k: a.astype(np.float32) for k, a in w.items()})


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> BagModel | None:
    """Fit on labelled rows with crc32(doc_id) mod 5 other than 0; None without labels.

    At most ``most`` rows, those with the smallest hash of the id, of at most ``SAMPLE_BYTES`` of text in all (a text that is too long for what is left is passed over), are
    encoded by the executors, all their passages, and sent to the driver. Of repeated labels of an id the
    largest counts.
    """
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("quality"))
    open_labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    drawn = open_labels.groupBy("doc_id").agg(F.max("quality").alias("y")).withColumn("_h", order).orderBy("_h", "doc_id").limit(most)
    drawn = cut(drawn)
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b")).join(F.broadcast(drawn.select("doc_id", "_h")), "doc_id").groupBy("doc_id", "_h").agg(F.sum("b").alias("b"))
    # at most ``most`` ids and sizes: a text that doesn't fit any more is passed over, and the next are tried
    taken, room = [], SAMPLE_BYTES
    for doc_id, size in sizes.orderBy("_h", "doc_id").select("doc_id", "b").collect():
        if size <= room:
            taken.append((doc_id,))
            room -= size
    fits = docs.sparkSession.createDataFrame(taken, drawn.select("doc_id").schema)
    drawn = cut(drawn.join(F.broadcast(fits), "doc_id", "left_semi"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("y").cast("double").alias("y"), "_h")
    found = rows.mapInArrow(_encode, "y double, h long, n int, x binary").collect()
    found = sorted(found, key=lambda r: (r["h"], bytes(r["x"])))
    if not found:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in found]).astype(np.float32)
    return fit_bags(x, np.r_[0, np.cumsum([r["n"] for r in found])], np.array([r["y"] for r in found]))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw, off in text_slices(batch.column(0)):
            x, bounds = passages(raw, off)
            bags = [x[s:e].astype(np.float16) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            part = batch.slice(i, len(bags))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([len(b) for b in bags], pa.int32()), pa.array([b.tobytes() for b in bags], pa.binary())], ["y", "h", "n", "x"])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages, told_by`` for every document.

    ``told_by`` is the number of the passage with the largest attention weight. All passages of a
    text count. Null and empty texts are one empty passage and are scored like any other; without
    labels every score is 0.5. Repeated rows are scored alike; scores have five decimals. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, raw, off in text_slices(batch.column(1)):
                x, bounds = passages(raw, off)
                n = len(bounds) - 1
                score, attention = model.attend(x, bounds) if model else (np.full(n, 0.5), np.ones(len(x)))
                told = [int(attention[s:e].argmax()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(i, n).column(0)
                yield pa.RecordBatch.from_arrays([part, pa.array(np.round(np.asarray(score, float), 5)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(told, pa.int32())], ["doc_id", "score", "passages", "told_by"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, passages int, told_by int")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "told_by")
