"""Keyed permutations of 0..n-1 without a sort: where an element goes is worked out from its number alone."""

import numpy as np

ROUNDS = 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each number (the finisher of a public-domain generator)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sides(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b >= n with both near the root of n, so that few places lie behind n."""
    a = np.maximum(np.ceil(np.sqrt(n)).astype(np.uint64), np.uint64(1))
    return a, np.maximum((n + a - np.uint64(1)) // a, np.uint64(1))


def _network(x: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A Feistel network on pairs from a times b: each round adds to one half a number that hangs on the other."""
    left, right = x // b, x % b
    for k in range(ROUNDS):
        salt = key + np.uint64(k)
        if k % 2:
            right = (right + mixed(mixed(salt) ^ left) % b) % b
        else:
            left = (left + mixed(mixed(salt) ^ right) % a) % a
    return left * b + right


def permuted(numbers: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each number below its `n` goes under its key. What lands behind n goes on until it is below (a cycle that began
    below n comes back there)."""
    numbers, n, key = (np.asarray(x).astype(np.uint64) for x in (numbers, n, key))
    if np.any(numbers >= n):
        raise ValueError("numbers must lie below n")
    a, b = _sides(n)
    out = _network(numbers, a, b, key)
    behind = np.flatnonzero(out >= n)
    while len(behind):
        out[behind] = _network(out[behind], a[behind], b[behind], key[behind])
        behind = behind[out[behind] >= n[behind]]
    return out.astype(np.int64)
