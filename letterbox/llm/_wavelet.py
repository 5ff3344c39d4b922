"""Wavelet matrix: token ids as bit-planes with rank directories, in one self-contained byte string.

Level 0 holds every id's highest bit in text order; each further level holds the next bit with the ids
stably parted by the bit before, zeros first. Rank directories count the ones before every 512th bit.
Layout: magic, length of a JSON header, header (n, bits, zeros per level, sizes of the parts, meta), then
zstd frames: each level's plane and directory, and the caller's arrays.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"LBXWM\x001\n"
STEP = 512


class WaveletMatrix:
    """Access, counting and occurrence look-up over n ids below 2**bits."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = ranks if ranks is not None else [_directory(p) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            zero = ~one
            zeros.append(int(np.count_nonzero(zero)))
            if b:
                x = np.concatenate([x.compress(zero), x.compress(one)])
        return cls(len(ids), planes, zeros)

    @property
    def bits(self) -> int:
        return len(self.planes)

    def decode(self) -> np.ndarray:
        """All ids in order, undoing the partings from the lowest level up."""
        value = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, back = self.zeros[level], np.empty_like(value)
            back[np.flatnonzero(~one)] = value[:z]
            back[np.flatnonzero(one)] = value[z:] | value.dtype.type(1 << (self.bits - 1 - level))
            value = back
        return value.astype("<u4")

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // STEP
        tail = np.unpackbits(self.planes[level][block * STEP // 8 : (i + 7) // 8], bitorder="little")[: i - block * STEP]
        return int(self.ranks[level][block]) + int(tail.sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first i ids."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def _select_bit(self, level: int, one: int, k: int) -> int:
        ones = self.ranks[level].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * STEP - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def to_bytes(self, arrays: dict[str, np.ndarray] | None = None, level: int = 1) -> bytes:
        arrays = arrays or {}
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True).compress
        parts = [pack(x.tobytes()) for pair in zip(self.planes, self.ranks, strict=True) for x in pair] + [pack(x.tobytes()) for x in arrays.values()]
        header = json.dumps({"n": self.n, "bits": self.bits, "zeros": self.zeros, "sizes": [len(x) for x in parts], "arrays": {k: str(v.dtype) for k, v in arrays.items()}}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, dict[str, np.ndarray]]:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = len(MAGIC) + 4
        (size,) = struct.unpack("<I", data[at - 4 : at])
        head = json.loads(data[at : at + size])
        at += size
        unpack = zstandard.ZstdDecompressor().decompress
        parts = []
        for size in head["sizes"]:
            if at + size > len(data):
                raise ValueError("the file is cut short")
            parts.append(unpack(data[at : at + size]))
            at += size
        planes = [np.frombuffer(x, np.uint8) for x in parts[: 2 * head["bits"] : 2]]
        ranks = [np.frombuffer(x, "<u4") for x in parts[1 : 2 * head["bits"] : 2]]
        arrays = {k: np.frombuffer(x, kind) for (k, kind), x in zip(head["arrays"].items(), parts[2 * head["bits"] :], strict=True)}
        return cls(head["n"], planes, head["zeros"], ranks), arrays


def _directory(plane: np.ndarray) -> np.ndarray:
    step = STEP // 8
    full = np.bitwise_count(plane).astype(np.int64)
    sums = np.add.reduceat(full, np.arange(0, len(full), step)) if len(full) else np.zeros(0, np.int64)
    return np.concatenate(([0], np.cumsum(sums))).astype("<u4")
