"""Cutting texts where a byte-level tokenizer's pattern cuts them, in numpy over code points.

The pattern is the one of the public vocabulary files:
`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Whether a piece begins at a code point depends on its neighbours alone, so no scan is needed.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from lekha.llm.text import Table, ragged, same_bytes, word_hash

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Unicode's White_Space (fixed values).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_EDGE = "\ud800"  # no text holds a lone surrogate

_kinds = np.full(0x110000, -1, np.int8)
_kinds[_WHITE], _kinds[ord(_EDGE)] = SPACE, EDGE


def _kind(points: np.ndarray) -> np.ndarray:
    out = _kinds[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]).tolist():
            _kinds[p] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(p))[0], OTHER)
        out = _kinds[points]
    return out


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, its code points, start, end, row): every piece of every text is string[start:end]; they cover the texts in order."""
    string = _EDGE + "".join(x + _EDGE for x in texts)
    points = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kind(points)
    space = points == 0x20
    start = np.ones(len(points), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    white, solid = kind == SPACE, (kind != SPACE) & (kind != EDGE)
    # the last of several white characters before a word stands alone, and a plain space joins the word
    start[:-1] |= white[:-1] & solid[1:]
    start[1:] &= ~(solid[1:] & space[:-1])
    # 's and the like, where the apostrophe itself begins a piece
    quote = np.flatnonzero(points == 0x27)
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a, b = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cut = quote[one | two]
        start[cut + 1] = False
        after = cut + np.where(one, 2, 3)[one | two]
        start[after] |= kind[after] == LETTER
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(points))
    edge = kind[begin] == EDGE
    row = np.cumsum(edge)[~edge] - 1
    begin, end = begin[~edge], end[~edge]
    return string, points, begin, end, row


class PieceCache:
    """What a worker has already worked out about pieces, by their hash and their characters; it starts anew when it is full."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.table, self.place, self.size = Table(), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.chars, self.filled = np.zeros(1 << 18, np.uint32), 0

    def numbers(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each piece's number; pieces that are new are worked out by `learn`. Never two different pieces with one number."""
        if self.table.n > self.most or self.filled > 16 * self.most:
            self._empty()
            self.clear()
        data = points.view(np.uint8)
        found, seed, todo = np.full(len(begin), -1, np.int64), 0, np.arange(len(begin))
        while len(todo):
            hashes = word_hash(data, 4 * begin[todo], 4 * end[todo], seed)
            at = self.table.find(hashes)
            new = np.flatnonzero(at < 0)
            if len(new):
                new = new[np.sort(np.unique(hashes[new], return_index=True)[1])]
                self._add(points, begin[todo[new]], end[todo[new]], hashes[new])
                at = self.table.find(hashes)
            length = (end - begin)[todo]
            same = self.size[at] == length
            same[same] = same_bytes(points, begin[todo[same]], self.place[at[same]], length[same], self.chars)
            found[todo[same]] = at[same]
            todo, seed = todo[~same], seed + 1  # others of a hash: by another hash
        return found

    def _add(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        length, n = end - begin, self.table.n
        while n + len(begin) > len(self.place):
            self.place, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.size))
        while self.filled + length.sum() > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.place[n : n + len(begin)], self.size[n : n + len(begin)] = self.filled + np.cumsum(length) - length, length
        self.chars[self.filled : self.filled + int(length.sum())] = points[ragged(begin, length)]
        self.filled += int(length.sum())
        self.learn(begin, end)
        self.table.add(hashes)

    def learn(self, begin: np.ndarray, end: np.ndarray) -> None:
        """Work out these pieces, which get the next numbers."""
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError


class IdCache(PieceCache):
    """Ids of the pieces already met."""

    def __init__(self, most: int = 700_000):
        super().__init__(most)
        self.clear()

    def clear(self) -> None:
        self.start, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def keep(self, count: np.ndarray, flat: np.ndarray) -> None:
        """The ids of the next numbers: how many each has, and all."""
        a, b = self.table.n, self.table.n + len(count)
        while b > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[a:b], self.count[a:b] = self.used + np.cumsum(count) - count, count
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def ids(self, found: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each row, all ids) for pieces by their numbers."""
        count = self.count[found].astype(np.int64)
        return np.bincount(row, count, rows).astype(np.int64), self.flat[ragged(self.start[found].astype(np.int64), count)]
