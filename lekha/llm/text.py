"""Numpy helpers over Arrow string columns, shared by the operators of this subpackage.

Everything works on slices of about a MB of text, so that memory in a task does not
depend on the number of rows in a batch; a single longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
_STRETCH = 1 << 18
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_GRAM = U64(0xC2B2AE3D27D4EB4F | 1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, and those of its inverse."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << int(n).bit_length()
            out = []
            for b in (self.base, self.inverse):
                a = np.full(n, b, U64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out
        return self.up, self.down


_POWERS = {int(b): _Powers(b) for b in (_BASE, _GRAM)}


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each pair, equal for equal contents wherever they lie; starts ascend.

    A polynomial: for candidates only, as long runs of a pattern can share it.
    """
    if len(values) > _STRETCH and len(starts) > 1:  # in stretches, for bounded tables of powers
        edge = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(values), _STRETCH)), len(starts)))
        out = np.empty(len(starts), U64)
        for a, b in zip(edge[:-1], edge[1:]):
            low = int(starts[a])
            part = values[low : int(ends[a:b].max())]
            same = len(part) == len(values)
            out[a:b] = _span_hash(part, starts[a:b] - low, ends[a:b] - low, base) if same else span_hash(part, starts[a:b] - low, ends[a:b] - low, base)
        return out
    return _span_hash(values, starts, ends, base)


def _span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    up, down = _POWERS[int(base)].upto(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=total[1:])
    length = (ends - starts).astype(U64)
    return mix((total[ends] - total[starts]) * down[starts] + length * U64(0xD6E8FEB86659FD93))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes data[s:e] for each pair; eight bytes at a time are mixed into what came before."""
    size = end - start
    out = mix(size.astype(U64) + U64(seed * 2 + 1))
    if not len(out):
        return out
    long = np.flatnonzero(size > _LONG)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    todo, at = np.flatnonzero(size <= _LONG) if len(long) else np.arange(len(out)), 0
    while len(todo):
        left = size[todo] - at
        lane = lanes[start[todo] + at]
        short = left < 8
        lane[short] &= _LOW[left[short]]
        out[todo] = mix(out[todo] ^ lane) + U64(0x9E3779B97F4A7C15)
        todo, at = todo[left > 8], at + 8
    return out


#: Longer words are hashed one by one.
_LONG = 256
#: The n lowest bytes of a lane.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)], U64)


def same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Whether data[start:start + size] is whole[other:other + size], for each triple; whole: data itself where not given."""
    whole, out = data if whole is None else whole, np.ones(len(start), bool)
    total = np.cumsum(size)
    edge = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, _STRETCH)), len(start)))
    for a, b in zip(np.append(0, edge[:-1]), edge):  # in stretches, for bounded index arrays
        if a == b:
            continue
        differ = data[ragged(start[a:b], size[a:b])] != whole[ragged(other[a:b], size[a:b])]
        bad = np.flatnonzero(differ)
        if len(bad):
            out[a + np.unique(np.searchsorted(total[a:b] - (total[a - 1] if a else 0), bad, "right"))] = False
    return out


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each word's number, its hash): equal numbers for equal bytes, different ones for others."""
    hashes = word_hash(data, start, end)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    leader = first[number]
    size = end - start
    odd = (size != size[leader]) | (leader != np.arange(len(start)))
    odd = np.flatnonzero(odd)
    alike = size[odd] == size[leader[odd]]
    alike[alike] = same_bytes(data, start[odd[alike]], start[leader[odd[alike]]], size[odd[alike]])
    own: dict[bytes, int] = {}
    for i in odd[~alike].tolist():  # other words of a hash
        number[i] = own.setdefault(data[start[i] : end[i]].tobytes(), len(first) + len(own))
    return number, hashes


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values (len(hashes) - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    starts = np.arange(len(hashes) - n + 1)
    return span_hash(hashes, starts, starts + n, _GRAM)


_kept: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What a Python worker keeps between tasks of one operator; what others kept there goes."""
    if operator not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)  # else freed memory stays with the worker
    return _kept.setdefault(operator, {})


class Texts(NamedTuple):
    """Some rows' texts as UTF-8; row r is data[begin[r]:begin[r + 1]]."""

    data: np.ndarray
    begin: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1


def texts(column: pa.Array) -> Texts:
    """Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[begin[0] : begin[-1]], begin - begin[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text."""
    for batch in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = length[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(length, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # row r has the words first[r]:first[r + 1]


def words(t: Texts, white: np.ndarray = WHITE) -> Words:
    """The runs of bytes outside `white`; none crosses rows."""
    n = len(t.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(t) + 1, np.int64))
    solid = ~white[t.data]
    cut = np.zeros(n + 1, bool)
    cut[t.begin] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end = solid
    end[:-1] &= ~solid[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(start, t.begin)
    return Words(start, end, np.repeat(np.arange(len(t)), np.diff(first)), first)


class Table:
    """From 64-bit keys to rows of numbers 0, 1, 2, ... by open addressing, all in numpy."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.at, self.n = np.zeros(size, U64), np.full(size, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        mask = len(self.at) - 1
        slot = (keys & U64(mask)).astype(np.int64)
        out = self.at[slot].copy()
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = self.at[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct new keys get the next numbers, in order."""
        while (self.n + len(keys)) * 2 > len(self.at):
            used = np.flatnonzero(self.at >= 0)
            old, number = self.keys[used], self.at[used]
            self.keys, self.at = np.zeros(2 * len(self.at), U64), np.full(2 * len(self.at), -1, np.int32)
            self._put(old, number)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.at) - 1
        slot = (keys & U64(mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.at[slot[todo]] < 0]
            self.at[slot[free]] = numbers[free]  # of several for one slot the last stays
            self.keys[slot[free]] = keys[free]
            todo = todo[self.at[slot[todo]] != numbers[todo]]
            slot[todo] = (slot[todo] + 1) & mask


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words data[s:e], a space after each, as one array, and where each begins in it."""
    length = end - start
    to = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(to[-1] + length[-1]) + 1 if len(to) else 0, 0x20, np.uint8)
    edge = np.unique(np.append(np.searchsorted(to, np.arange(0, len(out), _STRETCH // 2)), len(to)))
    for a, b in zip(edge[:-1], edge[1:]):  # in stretches, for bounded index arrays
        at = ragged(start[a:b], length[a:b])
        out[at + np.repeat(to[a:b] - start[a:b], length[a:b])] = data[at]
    return out, to
