"""Vectorised helpers over the raw UTF-8 buffers of Arrow string columns.

Everything here is pure NumPy on one slice of an Arrow batch at a time, so memory is bounded by
``SLICE_BYTES`` and the longest single text, never by the batch, the partition or the corpus. A text
longer than a slice is cut into words slice by slice; its words, not its bytes, are then held as numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: texts are worked on in runs of about so many bytes, so temporaries stay in the CPU caches
SLICE_BYTES = 1 << 18

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _large(column: pa.Array) -> pa.Array:
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    return column.fill_null("") if column.null_count else column


def text_runs(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first_row, end_row)`` of runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    column = _large(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first_row, bytes, offsets)`` for runs of rows; null texts are empty."""
    column = _large(column)
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i, j in text_runs(column, limit):
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse mod 2**64."""
    up, down = np.full(n, _BASE, _U), np.full(n, _BASE_INV, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


#: kept for slices of the usual length; a longer word has its own made for it
_KEPT = _powers(2 * SLICE_BYTES)


def _words_of_slice(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice and where in it each begins."""
    n = len(raw)
    low = _LOWER[raw]
    inside = ~_SEP[low]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    starts[edge] = inside[edge]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _KEPT if n < len(_KEPT[0]) else _powers(n + 1)
    acc = np.zeros(n + 1, _U)
    np.cumsum((low.astype(_U) + _U(1)) * up[:n], out=acc[1:])
    return mix((acc[b] - acc[a]) * down[a] + (b - a).astype(_U) * _MUL), a


def _cuts(raw: np.ndarray, limit: int = SLICE_BYTES) -> list[int]:
    """Places that cut a long text into runs of about ``limit`` bytes, none within a word."""
    cuts, at = [0], limit
    while at < len(raw):
        while at < len(raw):
            here = np.flatnonzero(_SEP[raw[at : at + limit]])
            if len(here):
                cuts.append(at + int(here[0]))
                break
            at += limit
        at = max(at, cuts[-1]) + limit
    return [*cuts, len(raw)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text and where each text's words begin.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A word's hash
    depends on its bytes alone. Returns ``(hashes, bounds)``; text ``i`` owns
    ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    if not len(raw):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(raw) > 2 * SLICE_BYTES:
        cuts = _cuts(raw)
        parts = [_words_of_slice(raw[s:e], np.array([0, e - s]))[0] for s, e in zip(cuts, cuts[1:], strict=False)]
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    hashes, at = _words_of_slice(raw, offsets)
    return hashes, np.searchsorted(at, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes of every text.

    A text with fewer words has its whole sequence as its one shingle; a text without words has
    none. Returns ``(values, bounds)`` like :func:`word_hashes`.
    """
    words, wb = word_hashes(raw, offsets)
    m = len(words)
    acc = np.zeros(max(0, m - width + 1), _U)
    for k in range(width):
        if len(acc):
            acc = acc * _MUL + words[k : m - width + 1 + k]
    acc = mix(acc)
    sets = []
    for s, e in zip(wb[:-1].tolist(), wb[1:].tolist(), strict=True):
        if e - s >= width:
            sets.append(np.unique(acc[s : e - width + 1]))
        elif e > s:
            short = int.from_bytes(hashlib.blake2b(words[s:e].tobytes(), digest_size=8).digest(), "little")
            sets.append(np.array([short], _U))
        else:
            sets.append(np.zeros(0, _U))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), bounds
