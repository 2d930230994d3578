"""Vectorised character n-grams of word lists and texts."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MULT
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(code: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of ``code`` that stay inside one group, and their
    groups."""
    m = len(code) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, group.dtype)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = h * _BASE + code[k:m + k].astype(np.uint64) + np.uint64(1)
    inside = group[:m] == group[n - 1:]
    return mix(h[inside]), group[:m][inside]


def word_grams(words: list[str], least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of ``least`` to ``most`` characters of the words
    between boundary marks, ordered by n-gram length."""
    code = codes("<" + "><".join(words) + ">")
    word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    ids, of = [], []
    for n in range(least, most + 1):
        h, g = gram_hashes(code, word, n)
        ids.append((h & np.uint64(buckets - 1)).astype(np.int32))
        of.append(g)
    return np.concatenate(ids), np.concatenate(of)
