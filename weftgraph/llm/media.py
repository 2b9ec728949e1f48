"""Motion-JPEG AVI as a media column (operator 4).

Payloads are stored as 24 x 24 frames of 8-bit samples in lossless JPEG (process 14, predictor 1),
one frame a chunk of an AVI file with an ``idx1`` index. Reading starts from the index, undoes the
entropy coding of many frames side by side and cuts clips where the grey histogram jumps.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: frames that are coded together
GROUP = 2048
#: Huffman table: one code of four bits for each category of a difference; all ones stays free
CODE_BITS = 4
def _code_bits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, which of them are used, and their number, of differences -255..255 and of 0..7 fill bits."""
    bits, used = np.zeros((519, CODE_BITS + 8), np.uint8), np.zeros((519, CODE_BITS + 8), bool)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        word = f"{cat:0{CODE_BITS}b}" + (f"{diff if diff > 0 else diff + (1 << cat) - 1:0{cat}b}" if cat else "")
        bits[diff + 255, : len(word)] = list(map(int, word))
        used[diff + 255, : len(word)] = True
    for fill in range(8):
        bits[511 + fill, :fill] = used[511 + fill, :fill] = True
    return bits, used, used.sum(1)


_BITS, _USED, _SIZE = _code_bits()


def _jpeg_head() -> bytes:
    dht = bytes([0, *(9 if k == CODE_BITS else 0 for k in range(1, 17)), *range(9)])
    sof = struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
    sos = bytes([1, 1, 0, 1, 0, 0])
    out = b"\xff\xd8"
    for marker, body in ((0xC4, dht), (0xC3, sof), (0xDA, sos)):
        out += bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    return out


HEAD = _jpeg_head()


def encode_scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of (frames, 24, 24) samples, a byte string a frame."""
    n = len(samples)
    img = samples.astype(np.int32)
    pred = np.empty_like(img)
    pred[:, :, 1:] = img[:, :, :-1]
    pred[:, 1:, 0] = img[:, :-1, 0]
    pred[:, 0, 0] = 128
    symbol = np.empty((n, FRAME + 1), np.int32)
    symbol[:, :FRAME] = (img - pred).reshape(n, FRAME) + 255
    bits = _SIZE[symbol[:, :FRAME]].sum(axis=1)
    symbol[:, FRAME] = 511 + (-bits % 8)  # ones up to the next byte
    data = np.packbits(_BITS[symbol][_USED[symbol]])
    base = np.r_[0, np.cumsum((bits + 7) // 8)]
    twice = data == 255
    grown = np.r_[0, np.cumsum(1 + twice)]
    out = np.zeros(grown[-1], np.uint8)
    out[grown[:-1]] = data
    cuts = grown[base]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of any number of frames, ``GROUP`` of them at a time."""
    return [scan for k in range(0, len(samples), GROUP) for scan in encode_scans(samples[k : k + GROUP])]


def write_avi(scans: list[bytes]) -> bytes:
    """An AVI file of such frames."""
    chunks, index, at = [], [], 4
    for scan in scans:
        size = len(HEAD) + len(scan) + 2
        chunks.append(struct.pack("<4sI", b"00dc", size) + HEAD + scan + b"\xff\xd9" + b"\0" * (size & 1))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        at += 8 + size + (size & 1)
    n, largest = len(scans), max(map(len, scans)) + len(HEAD) + 2

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack("<4sI", tag, len(body)) + body + b"\0" * (len(body) & 1)

    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl)
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def read_index(avi: bytes) -> tuple[list[tuple[int, int]], float]:
    """``(start, size)`` of each video frame by the file's index, and frames a second."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, entries, fps = -1, b"", float(FPS)
    end = min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0])
    todo = [(12, end)]
    while todo:
        at, stop = todo.pop()
        while at + 8 <= stop:
            tag, size = struct.unpack_from("<4sI", avi, at)
            if tag == b"LIST" and avi[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif tag == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif tag == b"strh" and avi[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", avi, at + 28)
                fps = rate / max(1, scale)
            elif tag == b"idx1":
                entries = avi[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    found = np.frombuffer(entries, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    video = found[found["id"] == b"00dc"]
    return [(movi + int(a) + 8, int(s)) for a, s in zip(video["at"], video["size"], strict=True)], fps


def _parse_head(frame: bytes) -> tuple[int, int, int, bytes]:
    """``(bytes of the head, rows, columns, Huffman table)`` of a lossless JPEG frame."""
    at, rows, columns, table = 2, 0, 0, b""
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            table = body
        elif marker == 0xC3:
            rows, columns = struct.unpack_from(">HH", body, 1)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless frames are read here")
        elif marker == 0xDA:
            return at, rows, columns, table


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit prefix the difference that it begins with and the bits that this takes."""
    if table not in _LOOKUPS:
        diff, size = np.zeros(65536, np.int32), np.full(65536, 16, np.int32)
        code, at = 0, 17
        for length in range(1, 17):
            for _ in range(table[length]):
                cat = table[at]
                if length + cat > 16:
                    raise ValueError("codes of over 16 bits with their value aren't read here")
                first, last = code << (16 - length), (code + 1) << (16 - length)
                extra = (np.arange(first, last) >> (16 - length - cat)) & ((1 << cat) - 1)
                diff[first:last] = np.where(extra >> max(cat - 1, 0) == 0, extra - (1 << cat) + 1, extra)
                size[first:last] = length + cat
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[table] = diff, size
    return _LOOKUPS[table]


def decode_scans(scans: list[bytes], rows: int, columns: int, table: bytes) -> np.ndarray:
    """(frames, rows, columns) samples; the frames are decoded in step, sample by sample."""
    diffs, sizes = _lookup(table)
    data = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    starts = np.r_[0, np.cumsum([len(s) for s in scans])][:-1]
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[1:] == 0) & (data[:-1] == 255)
    stuffed[-8:] = False
    starts = starts - np.r_[0, np.cumsum(stuffed)][starts]
    b = data[~stuffed].astype(np.int32)
    window = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    pos = (starts * 8).astype(np.int32)  # a group of frames has some megabytes
    diff = np.empty((rows * columns, len(scans)), np.int32)
    for i in range(rows * columns):
        head = (window.take(pos >> 3, mode="clip") >> (8 - (pos & 7))) & 65535
        diffs.take(head, out=diff[i], mode="clip")
        pos += sizes.take(head, mode="clip")
    d = diff.T.reshape(len(scans), rows, columns)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def shots(frames: np.ndarray, fps: float, window: int = 12, sigmas: float = 3.0, least: float = 0.12) -> list[tuple[int, int, float, float, float]]:
    """``(first, last, start_s, end_s, mean_grey)`` of the clips of a film.

    A cut is where the 16-bin histogram moves by more than ``least`` and by more than ``sigmas``
    deviations above the mean of the ``window`` moves before it. A lone frame is one clip.
    """
    n = len(frames)
    hist = np.concatenate([_histograms(frames[k : k + GROUP]) for k in range(0, n, GROUP)])
    move = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * frames[0].size)
    s1, s2 = np.r_[0, np.cumsum(move)], np.r_[0, np.cumsum(move * move)]
    k = np.arange(len(move))
    lo = np.maximum(0, k - window)
    seen = np.maximum(1, k - lo)
    mean = (s1[k] - s1[lo]) / seen
    spread = np.sqrt(np.maximum(0, (s2[k] - s2[lo]) / seen - mean * mean))
    cuts = [0, *(np.flatnonzero((move > least) & (move > mean + sigmas * spread) & (k > 0)) + 1).tolist(), n]
    grey = np.r_[0, np.cumsum(frames.reshape(n, -1).sum(1, dtype=np.int64))]
    return [(a, b - 1, a / fps, b / fps, float(grey[b] - grey[a]) / ((b - a) * frames[0].size)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    bins = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * 16
    return np.bincount(bins.ravel(), minlength=n * 16).reshape(n, 16)


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def _grouped(items: list, weight) -> Iterator[tuple[int, int]]:
    """Runs of items of about GROUP frames."""
    first, total = 0, 0
    for i, item in enumerate(items):
        total += weight(item)
        if total >= GROUP:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(items):
        yield first, len(items)


def encode_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text (null: empty) as an AVI file.

    Other columns are ignored, whatever their names; repeated rows give repeated files, an empty table
    none. A very long text is coded ``GROUP`` frames at a time and held as text, samples and file; RIFF and
    Spark's binary values both end at 2 GB, which is the longest file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in _grouped(sizes, lambda n: max(1, -(-n // FRAME))):
                texts = [(t.as_py() or "").encode() for t in batch.column(1).slice(a, b - a)]
                payloads = [payload_of(t) for t in texts]
                scans = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE))
                films, at = [], 0
                for p in payloads:
                    films.append(write_avi(scans[at : at + len(p) // FRAME]))
                    at += len(p) // FRAME
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array(films, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_films(films: Iterable[bytes]) -> Iterator[tuple[np.ndarray, float]]:
    """Frames and rate of each film; frames of films with the same head are decoded together, ``GROUP`` at a time."""
    scans: list[bytes] = []
    sizes: list[tuple[int, float]] = []
    head, parsed = b"", (0, 0, 0, b"")

    def flush() -> Iterator[tuple[np.ndarray, float]]:
        parts = [decode_scans(scans[k : k + GROUP], *parsed[1:]) for k in range(0, len(scans), GROUP)]
        frames = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((0, SIDE, SIDE), np.uint8)
        at = 0
        for n, fps in sizes:
            yield frames[at : at + n], fps
            at += n
        scans.clear()
        sizes.clear()

    for film in films:
        index, fps = read_index(film)
        mine = []
        for start, size in index:
            if not head or film[start : start + len(head)] != head:
                found = _parse_head(film[start : start + size])
                if head and mine:
                    raise ValueError("frames of one film differ in their heads")
                yield from flush()
                parsed, head = found, film[start : start + found[0]]
            mine.append(film[start + len(head) : start + size - 2])
        scans += mine
        sizes.append((len(mine), fps))
        if len(scans) >= GROUP:
            yield from flush()
    yield from flush()


def clip_rows(media: DataFrame) -> DataFrame:
    """``doc_id, clip, first_frame, last_frame, start_s, end_s, mean_grey`` of every film; null media have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(batch.column(1).is_valid())
            out = []
            for doc_id, (frames, fps) in zip(part.column(0).to_pylist(), decode_films(part.column(1).to_pylist()), strict=True):
                out += [(doc_id, k, *c) for k, c in enumerate(shots(frames, fps))]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_grey"])

    schema = "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, mean_grey double"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, schema)


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from each film of ``doc_id, n_bytes, media``; ``feature`` lists its clips.

    Equal texts give equal values. Repeated rows give repeated rows, an empty table none; a null
    ``media`` gives nulls. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in _grouped(sizes, lambda n: n // FRAME):
                part = batch.slice(a, b - a)
                films = part.column(2).to_pylist()
                decoded = decode_films(f for f in films if f is not None)
                out = []
                for film in films:
                    if film is None:
                        out.append((None,) * 6)
                        continue
                    frames, fps = next(decoded)
                    payload = frames.tobytes()
                    clips = ",".join(f"{i}-{j}@{s:.2f}-{e:.2f}~{g:.1f}" for i, j, s, e, g in shots(frames, fps))
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(film), hashlib.sha256(film).hexdigest(), f"frames={len(frames)};clips={clips}"))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
