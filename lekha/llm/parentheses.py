"""Ordered trees as balanced parentheses, with a range min-max tree over their excess and a rank directory."""

from __future__ import annotations

import numpy as np

#: Children of a node of the range min-max tree.
FAN = 64
#: Positions searched at once.
_AT_ONCE = 1 << 14


class Parentheses:
    """A tree from its nodes' depths in preorder (the root's is 0, no node is deeper than one below the one before).

    Node k opens at open[k]; `bits` has a 1 there and a 0 where a node closes.
    """

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - depth
        self.bits = np.zeros(2 * n, bool)
        self.bits[self.open] = True
        self.excess = np.cumsum(np.where(self.bits, 1, -1)).astype(np.int32)
        #: Least excess of each block, of each block of blocks, and so on.
        self.least = [self.excess]
        while len(self.least[-1]) > 1:
            below = self.least[-1]
            padded = np.full(-(-len(below) // FAN) * FAN, np.iinfo(np.int32).max, np.int32)
            padded[: len(below)] = below
            self.least.append(padded.reshape(-1, FAN).min(1))

    def _first(self, level: int, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """In the block of each position, the first position from there on whose least excess is no more than `most`; -1 for none."""
        values, lanes = self.least[level], np.arange(FAN)
        out = np.full(len(at), -1)
        for a in range(0, len(at), _AT_ONCE):
            x, m = at[a : a + _AT_ONCE], most[a : a + _AT_ONCE]
            where = (x // FAN * FAN)[:, None] + lanes
            ok = (where >= x[:, None]) & (where < len(values))
            ok &= values[np.minimum(where, len(values) - 1)] <= m[:, None]
            hit = ok.any(1)
            out[a : a + _AT_ONCE][hit] = where[hit, ok[hit].argmax(1)]
        return out

    def find_close(self, nodes: np.ndarray) -> np.ndarray:
        """Where each node closes: the first later position whose excess is one less than at its opening."""
        at, out = self.open[nodes] + 1, np.full(len(nodes), -1)
        most, level = self.excess[self.open[nodes]] - 1, 0
        todo, place, down = np.arange(len(nodes)), at, []
        while len(todo):  # up, until a block holds it
            found = self._first(level, place, most[todo])
            got = found >= 0
            down.append((level, todo[got], found[got]))
            todo, place, level = todo[~got], place[~got] // FAN + 1, level + 1
        for level, who, where in reversed(down):  # and down again
            for below in range(level - 1, -1, -1):
                where = self._first(below, where * FAN, most[who])
            out[who] = where
        return out

    def sizes(self) -> np.ndarray:
        """Nodes in each node's subtree, itself included."""
        return (self.find_close(np.arange(len(self.open))) - self.open + 1) // 2


class Rank:
    """Counts of marked positions before any position, from one number for each 64."""

    def __init__(self, marks: np.ndarray):
        padded = np.zeros(-(-(len(marks) + 1) // 64) * 64, bool)
        padded[: len(marks)] = marks
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word = at // 64
        low = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)
