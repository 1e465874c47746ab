"""Words and word shingles of texts, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def split(text: str | None) -> list[bytes]:
    """Words between U+0020 and U+0009 to U+000D, with A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(hashes))
    out = np.full(len(hashes) - width + 1, np.uint64(width))
    for k in range(width):
        out = (out ^ hashes[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    out *= _FACTOR
    out ^= out >> np.uint64(32)
    out.sort()  # faster than numpy's own search for distinct values
    first = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]
