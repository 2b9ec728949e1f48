"""Best-fit packing planned on a histogram of lengths (operator 1)."""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import cut, filed
from weftgraph.llm.textops import text_runs

MAX_TOKENS, END_ID, SALTS = 4096, 1, 64
#: words whose ids a Python worker remembers, of at most so many letters, so that it holds some 250 bytes for each;
#: all others go to the tokenizer whenever they come
CACHE_WORDS, CACHE_LETTERS = 120_000, 24
#: words that are joined to one text for the tokenizer
JOINED = 400
#: texts are worked on in runs of about so many bytes
RUN_BYTES = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids binary"


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = ~_LETTER[33:127]
_MARK[ord("|")] = False  # it stands within the names of special tokens


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with a space between every ASCII letter and a mark or digit behind it, and for every line feed.

    The tokenizer ends a word between the two anyhow, so ids stay as they are, but words come without their marks.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1
    out = np.insert(raw, ends, 32)
    out[out == 10] = 32
    moved = offsets + np.searchsorted(ends, offsets, "left")
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(out))


def _key(word: str) -> str:
    """ASCII words have the ids of their lower-case form."""
    return word.lower() if word.isascii() and "<|" not in word else word


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    parts between spaces and line feeds, one after the other. A run of texts is cut into parts by
    Arrow, different parts are coded once, and the ids are taken back in the texts' order.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.most = most

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; many are coded in one call and told apart by their tokens' places."""
        out: list[bytes] = []
        for s in range(0, len(words), JOINED):
            part = words[s : s + JOINED]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            at = np.array([first for first, _ in coded.offsets], np.int64)
            begin = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = (4 * np.searchsorted(at, begin)).tolist()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(spaced(texts), " ")
        coded = split.flatten().dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        words, known = list(map(_key, pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))), self.known
        values = list(map(known.get, words))
        new = list({w for w, v in zip(words, values, strict=True) if v is None})
        found = dict(zip(new, self.words(new), strict=True))
        ids = pa.array([found[w] if v is None else v for w, v in zip(words, values, strict=True)], pa.large_binary()).take(coded.indices)
        room = self.most - len(known)
        if room > 0:
            known.update((w, found[w]) for w in new[:room] if len(w) <= CACHE_LETTERS)
        places = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data = ids.buffers()[2]
        whole = memoryview(data) if data is not None else memoryview(b"")
        bounds = places[np.cumsum([0, *pc.list_value_length(split).to_pylist()])].tolist()
        return [bytes(whole[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


_CODERS: dict[str, WordIds] = {}


def coder(path: str, most: int) -> WordIds:
    if path not in _CODERS:
        _CODERS[path] = WordIds(path, most)
    return _CODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``doc_id, piece, start, length, ids``, little-endian unsigned 32-bit; only texts over ``max_tokens`` are cut.

    A null or empty text is one piece with the end id. A very long text is held once, with its parts and ids.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, wide = coder(tokenizer_path, cache_words), 4 * max_tokens
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i, j in text_runs(batch.column(1), RUN_BYTES):
                out: list[tuple] = []
                for doc_id, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), code(batch.column(1).slice(i, j - i)), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), wide)):
                        part = ids[at : at + wide]
                        out.append((doc_id, k, at // 4, len(part) // 4, part))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: ``(length, first_rank, per_bin, sequence, bins, offset)``.

    Each entry places ``per_bin * bins`` pieces of one length: piece ``first_rank + r`` goes to
    sequence ``sequence + r // per_bin`` at ``offset + (r % per_bin) * length``. Sequences with equal
    room are handled as ranges of numbers, so the work depends on the number of lengths, not of documents.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted; room -> ranges of sequences
    ranges: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            mine = ranges[room]
            if mine and mine[-1][0] + mine[-1][1] == first:
                mine[-1] = (mine[-1][0], mine[-1][1] + n)
            else:
                mine.append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0

        def use(room: int, first: int, n: int, length: int = length) -> int:
            """Fill up to n sequences; the number of them that are used up."""
            nonlocal left, rank
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, per, first, full, capacity - room))
                give(room - per * length, first, full)
                left, rank = left - per * full, rank + per * full
            if full < n and left:  # the last one takes what is left
                plan.append((length, rank, left, first + full, 1, capacity - room))
                give(room - left * length, first + full, 1)
                left, rank, full = 0, rank + left, full + 1
            return full

        at = bisect.bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            todo = ranges.pop(room)
            rooms.pop(at)
            rest: list[tuple[int, int]] = []
            for first, n in todo:
                took = use(room, first, n) if left else 0
                if took < n:
                    rest.append((first + took, n - took))
            for first, n in rest:
                give(room, first, n)
            at = bisect.bisect_left(rooms, length) if left else at
        if left:
            per = capacity // length
            need = -(-left // per)
            use(capacity, made, need)
            made += need
    return plan


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS, salts: int = SALTS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    The driver sees one number per length (at most ``capacity`` of them) and plans best-fit
    decreasing on these. A piece's rank within its length is its rank within (length, salt) plus
    the pieces of lower salts, so a length that most pieces share is ranked in ``salts`` tasks.
    The plan then says slot by slot where each rank goes. Ties and repeated rows get different
    ranks; an empty table gives an empty plan. Other columns pass through.
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumn("_crc", F.crc32("ids")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "_crc"), F.lit(salts)).cast("int"))
    hist = keyed.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    hist = cut(hist)
    counts = {int(r["length"]): int(r["n"]) for r in hist.groupBy("length").agg(F.sum("_c").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    lower = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = hist.select("length", "_salt", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "_crc")
    ranked = keyed.withColumn("_r", F.row_number().over(inside) - 1).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_base"))
    schema = "length long, _first long, _per long, _seq long, _bins long, _off long"
    slots = spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema)
    # one row per run of equal placements, a few per length: bounded by the capacity, not by the data
    placed = ranked.join(F.broadcast(slots), "length").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_per") * F.col("_bins")))
    at = F.col("_rank") - F.col("_first")
    return placed.select(
        *[c for c in pieces.columns],
        (F.col("_seq") + F.expr("(_rank - _first) div _per")).cast("long").alias("sequence_id"),
        (F.col("_off") + at % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece of every document: its ids, their crc32, and where it stands in which sequence.

    A null text is empty and holds only the end id. Repeated documents are packed as often as
    they are there; columns of ``docs`` other than ``doc_id`` and ``text`` are ignored. Pieces with their
    ids are written to the shared folder once; who selects no ids doesn't shuffle them either.
    """
    pieces = filed(token_pieces(docs, tokenizer_path, max_tokens, cache_words=cache_words), "pieces")
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences, each the ids of its pieces one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts"))
    return whole.select("sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"))
