"""64-bit SimHash of word shingles (pure numpy / xxhash, no Spark)."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

#: shingles hashed at once; bounds the memory a very long text needs
BLOCK = 1 << 16


def shingle_hashes(text: str | None, k: int):
    """Yield arrays of the XXH64 (seed 42) of every k-word shingle of ``text``.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are space-joined and
    repeats count. Fewer than k words give one shingle, the whole sequence; no word gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    for at in range(0, len(first), BLOCK):
        lo, hi = first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist()
        pieces = map(joined.__getitem__, map(slice, lo, hi))
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(lo))


def simhash(text: str | None, k: int = 4) -> int:
    """Bit b is set when more than half of the shingle hashes have it; 0 without shingles."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, k):
        total += len(h)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])
