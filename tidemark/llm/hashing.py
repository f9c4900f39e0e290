"""Words and shingles of whole batches as 64-bit hashes, by numpy on the bytes of Arrow's text arrays.

Words are the runs of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial of its bytes
modulo 2**64 (from prefix sums, so that each byte is touched a few times only), mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words up to each text's end); null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    left, right = np.empty(len(data), bool), np.empty(len(data), bool)
    left[1:], right[:-1] = space[:-1], space[1:]
    left[offsets[:-1][offsets[:-1] < len(data)]] = True
    right[offsets[1:][offsets[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(left & ~space), np.flatnonzero(right & ~space) + 1
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    words = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(begin, offsets[1:], side="left")


def shingle_sets(words: np.ndarray, ends: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles of n words, ascending, number of them up to each text's end).

    A text of fewer words has them all as one shingle; one without words has none.
    """
    counts = np.diff(ends, prepend=0)
    begins = ends - counts
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) for j in range(n)]
    for j in range(n):
        total += words[j : j + len(total)] * factors[j]
    total = mix(total)
    parts = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= n:
            own = np.sort(total[b : e - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            parts.append(own[keep])
        elif e > b:
            short = np.full(1, e - b, np.uint64)
            for j in range(e - b):
                short += words[b + j : b + j + 1] * factors[j]
            parts.append(mix(short ^ np.uint64(0xA0761D6478BD642F)))
        else:
            parts.append(total[:0])
    return np.concatenate(parts) if parts else total[:0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
