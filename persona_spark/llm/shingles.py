"""Word shingles of whole texts as 64-bit hashes, worked out on the bytes of a text at once."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5

_rng = np.random.default_rng(2024)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, kept between calls."""
    global _powers
    if len(_powers[0]) < size:
        size = 1 << (size - 1).bit_length()
        tables = []
        for factor in (_FACTOR, _INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(tables)
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words between white space, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    white = _WHITE[data]
    edge = np.diff(white.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence with fewer words; none without words."""
    words = word_hashes(text or "")
    width = min(SHINGLE_WORDS, len(words))
    if not width:
        return words
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(_FACTOR) + words[k : len(words) - width + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)
