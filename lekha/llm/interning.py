"""Byte runs of a batch by number: an open-addressed numpy table under XXH64 keys, equal by their bytes."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

from lekha.llm.text import U64, same_bytes

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Runs of at least so many bytes have another form of the hash and go one by one.
_LONG = 32


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of data[s:e] for each pair."""
    size = end - start
    out = (size.astype(U64) + U64(seed)) + _P5
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    todo, at = np.flatnonzero((size >= 8) & (size < _LONG)), start.copy()
    while len(todo):
        out[todo] = _turned(out[todo] ^ (_turned(lanes[at[todo]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[todo] += 8
        todo = todo[end[todo] - at[todo] >= 8]
    todo = np.flatnonzero((size < _LONG) & (end - at >= 4))
    out[todo] = _turned(out[todo] ^ ((lanes[at[todo]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[todo] += 4
    todo = np.flatnonzero((size < _LONG) & (end > at))
    while len(todo):
        out[todo] = _turned(out[todo] ^ (data[at[todo]].astype(U64) * _P5), 11) * _P1
        at[todo] += 1
        todo = todo[end[todo] > at[todo]]
    out ^= out >> U64(33)
    out *= _P2
    out ^= out >> U64(29)
    out *= _P3
    out ^= out >> U64(32)
    for i in np.flatnonzero(size >= _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


class Interned:
    """The different runs data[s:e]: `slot` has the table's slot of every run, `used` the slots in use, `bucket` and `count` stand in these slots.

    A slot belongs to one of its runs, and a run that hashes to a slot with other bytes goes on to the next.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int):
        n = len(start)
        keys, size, width = xxh64(data, start, end), end - start, 1 << max(4, (2 * n).bit_length())
        owner = np.full(width, -1, np.int64)
        slot = (keys & U64(width - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            at = slot[todo]
            free = owner[at] < 0
            owner[at[free]] = todo[free]  # of several for one slot the last stays
            lead = owner[at]
            same = (keys[lead] == keys[todo]) & (size[lead] == size[todo])
            look = np.flatnonzero(same & (lead != todo))
            same[look] = same_bytes(data, start[todo[look]], start[lead[look]], size[todo[look]])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (width - 1)
        self.slot, self.used = slot, np.flatnonzero(owner >= 0)
        whole, lead = memoryview(data), owner[self.used]
        self.bucket, self.count = np.zeros(width, np.int64), np.bincount(slot, minlength=width)
        self.bucket[self.used] = np.array([zlib.crc32(whole[a:b]) for a, b in zip(start[lead].tolist(), end[lead].tolist())], np.int64) % buckets
