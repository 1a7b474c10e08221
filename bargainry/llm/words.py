"""Hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; emptied when it has grown to ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: bytes | None) -> list[bytes]:
    """bytes.split() parts at space, tab, newline, vertical tab, form feed, carriage return."""
    return text.split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def runs(hashes: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """The hash of the k words from each position on (empty if there are fewer); another base gives another hash."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    out, width = hashes, 1
    for bit in bin(k)[3:]:
        out = out[:-width] * np.power(base, np.uint64(width)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * base + hashes[width:]
            width += 1
    return mixed(out)


def sliding(values: np.ndarray, k: int, best=np.minimum) -> np.ndarray:
    """The minimum (or maximum) of each k neighbours."""
    out, width = values, 1
    while width < k:
        step = min(width, k - width)
        out = best(out[: len(out) - step], out[step:])
        width += step
    return out
