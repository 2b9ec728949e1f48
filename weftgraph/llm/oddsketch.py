"""MinHash band keys and odd sketches of shingle sets (NumPy only)."""

from __future__ import annotations

import math

import numpy as np

from weftgraph.llm.textops import mix

_U = np.uint64
SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
SKETCH_BITS = 512
_A = mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
_B = mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xA0761D6478BD642F))


def minhashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) minima; ``bounds`` must describe non-empty sets only."""
    out = np.empty((len(bounds) - 1, SAMPLES), _U)
    starts = bounds[:-1]
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(values * _A[k] + _B[k], starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys; each band has its own key space."""
    m = mins.reshape(len(mins), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x8EBC6AF09C88C6E3), m.shape[:2]).copy()
    for r in range(ROWS):
        acc = mix(acc ^ m[:, :, r])
    return acc


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 8) bytes; bit p is the parity of the samples that fall on p."""
    n = len(mins)
    slot = (mix(mins ^ _B) % _U(SKETCH_BITS)).astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(slot.ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def estimate(xor_count: np.ndarray) -> np.ndarray:
    """Jaccard similarity told by the population count of two sketches' XOR."""
    x = np.minimum(np.asarray(xor_count, float), SKETCH_BITS / 2 - 0.5)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - 2 * x / SKETCH_BITS)


def most_xor(similarity: float, sigmas: float = 6.0) -> int:
    """Largest XOR count that a pair of at least this similarity shows, up to ``sigmas`` deviations.

    Differing samples are binomial, each flips two bits, and two flips of one bit cancel, so the
    count is at most the number of flips; its own spread is below the binomial one.
    """
    differ = SAMPLES * (1 - similarity) + sigmas * math.sqrt(SAMPLES * similarity * (1 - similarity))
    flips = 2 * min(differ, SAMPLES)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS)) + 6)
