"""Hashes of words and of runs of words, on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from millrace.llm.arrow import worker_memo

#: Words kept by a worker's memo before it is emptied.
MEMO_WORDS = 300_000
#: The base of the rolling hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            self[word] = value
        return value


def word_hashes() -> WordHashes:
    """The memo of this Python worker."""
    return worker_memo(("hashes",), WordHashes)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def rolled(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` values, modulo 2**64.

    The hash of a run is its values as digits in ``base``.  Runs of doubling
    widths are built from two halves and then joined to the width asked for.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, part = base, 1, values  # part: hashes of runs of ``size``, power: base**size
    done: np.ndarray | None = None
    taken, left = 0, width
    while left:
        if left & 1:
            tail = part[taken : taken + n]
            done = tail.copy() if done is None else done * np.uint64(power) + tail
            taken += size
        left >>= 1
        if left:
            part = part[:-size] * np.uint64(power) + part[size:]
            power = power * power & _MASK
            size *= 2
    return done


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that spreads the bits."""
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))
