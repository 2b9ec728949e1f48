"""Language identification in two steps (operator 3).

A document's language family is predicted first; within the family one-versus-one linear support
vector machines vote for the language. All are linear in relative frequencies of hashed byte
n-grams (1 to 4 bytes) of the whole text, so a text costs one histogram and one small product.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import crc_mod, spare
from weftgraph.llm.textops import text_slices

_U = np.uint64
DIMS = 2048
#: labelled rows that the classifiers are fitted on, at most, for each language and in all (4 KB each on the driver)
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 12_000
#: bytes of a text whose grams are counted at a time
CHUNK = 1 << 16
#: a score below this has a margin against it: no family claims the text, or another language is nearer
MIN_SCORE = 0.25

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "indo-iranian": "bn fa gu hi ku mr ne pa ps si ur",
    "turkic": "az kk ky tr tk uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """A language that isn't listed is a family of its own."""
    return _FAMILY.get(lang.lower(), f"other:{lang}")


def gram_frequencies(raw: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(texts, dims) relative frequencies of hashed 1- to 4-byte grams, A-Z lower-cased.

    Runs of anything but letters count as one space, so layout and junk marks carry no weight. A
    long text is counted ``CHUNK`` bytes at a time, so it takes a few bytes of memory a byte.
    """
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    for i in range(n):
        b = _FOLD[raw[offsets[i] : offsets[i + 1]]]
        if not len(b):
            continue
        keep = b != 32
        keep[1:] |= b[:-1] != 32
        x = np.concatenate((_SPACE, b[keep], _SPACE))
        counts = np.zeros(dims, np.int64)
        for s in range(0, len(x), CHUNK):
            part = x[s : s + CHUNK + 3].astype(np.uint32)
            acc, own = part, min(CHUNK, len(x) - s)
            grams = [part[:own]]
            for k in range(1, 4):
                acc = acc[:-1] * np.uint32(257) + part[k:]
                grams.append(acc[:own] + np.uint32(k << 28))
            g = np.concatenate(grams) * np.uint32(2654435769)
            counts += np.bincount((g >> np.uint32(21)).astype(np.int64) % dims, minlength=dims)
        out[i] = counts / counts.sum()
    return out


_SPACE = np.array([32], np.uint8)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of an L2-loss linear SVM by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    # both classes weigh the same
    c = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    diag = 1 / (2 * c)
    q = (x * x).sum(1) + diag
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


@dataclass(frozen=True)
class LanguageModel:
    """``families`` in order with their one-versus-rest rows, ``pairs`` of languages in a family."""

    languages: tuple[str, ...]
    families: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    scale: np.ndarray
    family_rows: np.ndarray
    pair_rows: np.ndarray

    def predict(self, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores in 0..1 for each row of frequencies.

        Margins are rounded, so that a row is judged alike whatever rows are multiplied with it.
        """
        n = len(freq)
        x = np.hstack([freq * self.scale, np.ones((n, 1), np.float32)]).astype(np.float64)
        fam = np.zeros(n, np.int64)
        sure = np.ones(n)
        if len(self.families) > 1:
            margin = np.round(x @ self.family_rows.T.astype(np.float64), 6)
            fam = margin.argmax(1)
            sure = 1 / (1 + np.exp(-2 * np.clip(margin.max(1), -30, 30)))
        votes = np.full((n, len(self.languages)), -1e9)
        for k, lang in enumerate(self.languages):
            votes[fam == self.families.index(family_of(lang)), k] = 0
        least = np.full((n, len(self.languages)), 30.0)
        if self.pairs:
            margin = np.round(x @ self.pair_rows.T.astype(np.float64), 6)
            for p, (a, b) in enumerate(self.pairs):
                m = margin[:, p]
                votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
                votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        won = least[np.arange(n), best]
        return best, sure / (1 + np.exp(-2 * np.clip(won, -30, 30)))


def fit_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Fit on rows with a lang and crc32(doc_id) mod 4 other than 2; None if there are none.

    Of each language at most ``per_language`` rows, those with the smallest hash of the id, are
    turned into frequencies by the executors and sent to the driver; whole texts are used. With very many
    languages each gives fewer, so that there are ``SAMPLE_ROWS`` in all.
    """
    open_rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["count"] for r in open_rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    per_language = max(1, min(per_language, SAMPLE_ROWS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 1.3 * per_language / n + 8 / n)) for lang, n in counts.items()], "lang string, _share double")
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid"))
    drawn = open_rows.withColumn("_h", order).join(F.broadcast(shares), "lang").where(F.pmod("_h", F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    rows = drawn.select("lang", "text", "_h").mapInArrow(_frequencies, "lang string, h long, freq binary").orderBy("h", "lang", "freq").limit(2 * per_language * len(counts) + 16 * len(counts)).collect()
    x, y, seen = [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if seen[r["lang"]] < per_language:
            seen[r["lang"]] += 1
            x.append(np.frombuffer(r["freq"], np.float16).astype(np.float32))
            y.append(r["lang"])
    if not x:
        return None
    freq, lang = np.stack(x), np.array(y)
    scale = (1 / np.sqrt(freq.mean(0) + 1e-5)).astype(np.float32)
    scale /= np.sqrt(((freq * scale) ** 2).sum(1).mean() + 1e-9)
    z = freq * scale
    languages = tuple(sorted(set(y)))
    family = np.array([family_of(v) for v in y])
    families = tuple(sorted(set(family)))
    fam_rows = [linear_svm(z, np.where(family == f, 1, -1)) for f in families] if len(families) > 1 else [np.zeros(DIMS + 1)]
    pairs, pair_rows = [], []
    for a, b in combinations(range(len(languages)), 2):
        if family_of(languages[a]) == family_of(languages[b]):
            mine = (lang == languages[a]) | (lang == languages[b])
            pairs.append((a, b))
            pair_rows.append(linear_svm(z[mine], np.where(lang[mine] == languages[a], 1, -1)))
    wide = (len(pair_rows), DIMS + 1)
    return LanguageModel(languages, families, tuple(pairs), scale, np.array(fam_rows, np.float32), np.array(pair_rows, np.float32).reshape(wide))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw, off in text_slices(batch.column(1)):
            freq = gram_frequencies(raw, off).astype(np.float16)
            part = batch.slice(i, len(freq))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array([f.tobytes() for f in freq], pa.binary())], ["lang", "h", "freq"])


def identify(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, the predicted language and its score, from the text alone.

    A text that is null or has no letter gives ``und`` with score 1, as does every text when there
    is no model. Ties go to the language that sorts first. Columns of ``docs`` with one of ``names``
    are replaced; all others, whatever they are called, pass through. Texts of any length are read whole.
    """
    base = docs.drop(*names)
    schema = base.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    at = base.columns.index("text")
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(schema))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lang, score = np.full(batch.num_rows, "und", object), np.ones(batch.num_rows)
            texts = batch.column(at)
            for i, raw, off in text_slices(texts) if known else ():
                best, sure = known.predict(gram_frequencies(raw, off))
                for k, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    if _ASCII_LETTER[raw[s : min(e, s + 4096)]].any() or has_letter(texts[i + k].as_py() or ""):
                        lang[i + k], score[i + k] = known.languages[best[k]], sure[k]
            columns = [*(c.cast(f.type) for c, f in zip(batch.columns, fields, strict=False)), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return base.mapInArrow(run, schema)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def identify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each document; see :func:`identify`.

    Other columns are ignored, whatever their names. A null doc_id hashes as the empty text.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    model = fit_languages(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: Collection[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents of ``languages`` (all that the model knows, if None) with ``min_score``, with the columns of ``docs``.

    Texts that are null or have no letter go. Without a model, as no row has a lang to fit on,
    nothing tells languages apart: all texts with a letter stay, whatever ``languages`` says.
    """
    model = fit_languages(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = spare(docs, "lang_pred", "score")
    kept = identify(docs, model, (pred, score)).where((F.col(pred) != "und") & (F.col(score) >= min_score))
    if languages is not None:
        kept = kept.where(F.col(pred).isin(*languages))
    return kept.select(*[f"`{c}`" for c in docs.columns])
