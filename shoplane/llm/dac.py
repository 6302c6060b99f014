"""Directly addressable codes of a sequence of token ids (numpy, one segment).

An id is cut into 8-bit chunks, lowest first. Level 0 holds every id's first
chunk; a continuation bitmap marks the ids that go on, whose next chunks stand,
in order, on level 1, and so on. A rank directory (set bits before each block of
512) finds an id's place on the next level, so one token is read with a few
lookups and nothing is decoded around it.

Layout, little-endian: magic ``DAC1``, u32 levels, u64 ids; then for each level
u64 chunks; then for each level its chunks, its bitmap (padded to whole bytes)
and its directory (u32 a block).
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """The segment's bytes; ``ids`` are unsigned 32-bit."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        directory = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4") if len(per_block) else per_block.astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8), bits, directory))
        rest = rest[goes_on] >> 8
        if not len(rest):
            break
    head = MAGIC + np.array([len(levels)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    head += np.array([len(chunks) for chunks, _, _ in levels], "<u8").tobytes()
    return head + b"".join(x.tobytes() for level in levels for x in level)


class Segment:
    """Read access to one encoded segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.n = int(np.frombuffer(data, "<u8", 1, 8)[0])
        sizes = np.frombuffer(data, "<u8", n_levels, 16).tolist()
        at = 16 + 8 * n_levels
        self.levels = []
        for size in sizes:
            n_bits, n_dir = -(-size // 8), -(-size // BLOCK)
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + size)
            directory = np.frombuffer(data, "<u4", n_dir, at + size + n_bits)
            self.levels.append((chunks, bits, directory))
            at += size + n_bits + 4 * n_dir

    def token(self, i: int) -> int:
        """Id number ``i``, by rank from level to level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * BLOCK // 8:i >> 3]
            i = int(directory[block]) + int(_ONES[before].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, np.uint32)
        places = np.arange(self.n)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            places = places[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out
