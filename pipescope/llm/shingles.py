"""Hashed words and word shingles of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import xxhash

from pipescope.llm.common import worker_cache

MAX_WORDS = 100_000
MUL, ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row and the number of words of each text.

    A-Z count as lower case; words are runs of anything but the six ASCII white-space characters, which is what
    splitting bytes gives.
    """
    cache = worker_cache("words")
    hashes = cache.get("hashes")
    if hashes is None or len(hashes) > MAX_WORDS:
        hashes = cache["hashes"] = _WordHashes()
    listed = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.fromiter(map(len, listed), np.int64, len(listed))
    return np.fromiter(map(hashes.__getitem__, chain.from_iterable(listed)), np.uint64, int(counts.sum())), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of `size` words in order, and how many each text has.

    A text with words, but fewer than `size`, has one shingle: all its words.
    """
    n = len(words)
    starts = np.cumsum(counts) - counts
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offset = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    at = np.repeat(starts, per) + offset
    length = np.repeat(np.minimum(counts, size), per)
    out = length.astype(np.uint64)
    for i in range(size):
        use = i < length
        following = words[np.minimum(at + i, n - 1)] if n else words
        out = np.where(use, out * MUL + following + ADD, out)
    return mix(out), per
