"""Token counts from a byte-pair vocabulary compiled into a deterministic transducer.

A state stands for what the bytes read so far of a piece still allow: each place from which some
token may yet reach beyond, with the token that ends there and the tokens up to there. A token ends
the merge procedure's result for a prefix exactly if it fits the token before it (no merge crosses
their border), so the next byte fixes the next state and how the count changes, which annotates the
transition. States and transitions are compiled when first met and kept by the worker.

Pieces step through the transducer side by side, one byte of each at a time. Long pieces are cut
into chunks, and each chunk's map (from the state it is entered in to the state it is left in, with
its count) is taken for the entry that the bytes just before it lead to. Neighbouring maps are then
composed pair by pair, spans doubling each time; where the left one is left in a state that the right
one has no entry for, that entry is added, as far into the right one as it makes a difference. Counts
of pieces already met come from a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.pretoken import PieceCache, pieces
from lekha.llm.shared import bounded_batches
from lekha.llm.text import U64, Table, mix, slices, worker_cache

CHUNK = 512
_LOOK_BACK = 96


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Bytes 0 to 255 are tokens 0 to 255 here, and merge m makes token 256 + m."""

    def __init__(self, merges: list):
        letters = _byte_letters()
        number = {c: b for c, b in letters.items()}
        self.made: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(256)), list(range(256))
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b in range(256):
            self._insert(bytes([b]), b)
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            t = len(self.left)
            self.made[number[a], number[b]] = t
            self.left.append(number[a]), self.right.append(number[b])
            number[a + b] = t
            self._insert(bytes(letters[c] for c in a + b), t)
        self.fit: dict[tuple[int, int], bool] = {}
        start = ((0, -1, 0),)
        self.states, self.ids = [start], {start: 0}
        self.table, self.next, self.emit = Table(), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16)

    def _insert(self, data: bytes, token: int) -> None:
        node = 0
        for b in data:
            new = self.trie[node].get(b)
            if new is None:
                new = self.trie[node][b] = len(self.trie)
                self.trie.append({})
                self.token.append(-1)
            node = new
        self.token[node] = token

    def fits(self, a: int, b: int) -> bool:
        """No merge joins the end of a and the begin of b. Walks back through both tokens' merges, the last first."""
        key = a, b
        if (known := self.fit.get(key)) is None:
            known, before, made = True, len(self.left), self.made
            while True:
                if made.get((a, b), before) < before:
                    known = False
                    break
                if a > b and a > 255:
                    before, a = a, self.right[a]
                elif b > 255:
                    before, b = b + 1, self.left[b]
                else:
                    break
            self.fit[key] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        live, token, emit = [], -1, 0
        for node, last, count in self.states[state]:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            t = self.token[node]
            if token < 0 and t >= 0 and (last < 0 or self.fits(last, t)):
                token, emit = t, count + 1
            if self.trie[node]:
                live.append((node, last, count))
        new = (*((node, last, count - emit) for node, last, count in live), (0, token, 0))
        at = self.ids.get(new)
        if at is None:
            at = self.ids[new] = len(self.states)
            self.states.append(new)
        return at, emit

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(U64) << U64(8) | byte.astype(U64)
        mixed = mix(key)
        at = self.table.find(mixed)
        if (at < 0).any():
            new = np.unique(key[at < 0])
            n = self.table.n + len(new)
            if n > len(self.next):
                self.next, self.emit = (np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)]) for x in (self.next, self.emit))
            for i, k in enumerate(new.tolist(), self.table.n):
                self.next[i], self.emit[i] = self._compile(k >> 8, k & 255)
            self.table.add(mix(new))
            at = self.table.find(mixed)
        return self.next[at], self.emit[at].astype(np.int64)

    def run(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state each stretch data[begin:begin + length] is left in, and its count, side by side."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[order].copy()
        count = np.zeros(len(order), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, "left"))  # those longer than k
            state[:n], more = self.step(state[:n], data[begin[:n] + k])
            count[:n] += more
        back = np.argsort(order)
        return state[back], count[back]

    def counts(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        parts = np.maximum(1, -(-length // CHUNK))
        piece = np.repeat(np.arange(len(begin)), parts)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begin[piece] + nth * CHUNK
        size = np.minimum(CHUNK, length[piece] - nth * CHUNK)
        entry = np.zeros(len(at), np.int64)
        later = np.flatnonzero(nth)
        if len(later):  # the entry that the bytes before lead to, most likely
            entry[later] = self.run(data, at[later] - _LOOK_BACK, np.full(len(later), _LOOK_BACK), entry[later])[0]
        left, count = self.run(data, at, size, entry)
        return self._composed(data, at, size, piece, entry, left, count, len(begin))

    def _composed(self, data, at, size, piece, entry, left, count, pieces: int) -> np.ndarray:
        """Each piece's count, by composing its chunks' maps entry -> (left, count); spans double."""
        first = last = np.arange(len(piece))  # a span of chunks has the map entry[first] -> (left[last], total)
        total = count.copy()
        while len(first) > pieces:
            of = piece[first]
            nth = np.arange(len(first)) - np.searchsorted(of, of)
            right = np.flatnonzero(nth % 2)
            new = left[last[right - 1]]
            wrong = right[entry[first[right]] != new]
            if len(wrong):
                total[wrong] += self._enter(data, at, size, entry, left, count, first[wrong], last[wrong], left[last[wrong - 1]])
            total[right - 1] += total[right]
            end = last.copy()
            end[right - 1] = last[right]
            keep = nth % 2 == 0
            first, last, total = first[keep], end[keep], total[keep]
        out = np.zeros(pieces, np.int64)
        out[piece[first]] = total
        return out

    def _enter(self, data, at, size, entry, left, count, first, last, state) -> np.ndarray:
        """Give spans of chunks another entry, and return by how much their counts change; the chunks' maps change until they agree with the old ones."""
        change, todo, chunk = np.zeros(len(first), np.int64), np.arange(len(first)), first.copy()
        while len(todo):
            entry[chunk] = state
            new, n = self.run(data, at[chunk], size[chunk], state)
            change[todo] += n - count[chunk]
            count[chunk] = n
            go = (new != left[chunk]) & (chunk < last[todo])
            left[chunk] = new
            todo, chunk, state = todo[go], chunk[go] + 1, new[go]
        return change


class _Counter(PieceCache):
    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = spec["model"]["merges"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fst = Transducer(self.merges)
        self.clear()

    def clear(self) -> None:
        self.value = np.zeros(1 << 16, np.int32)
        if len(self.fst.states) > 2_000_000:
            self.fst = Transducer(self.merges)

    def __call__(self, texts: list[str]) -> np.ndarray:
        for special in self.special:  # one token wherever it stands; the text around it is cut there
            if any(special in x for x in texts):
                parts = [x.split(special) for x in texts]
                own = self([p for x in parts for p in x])
                edge = np.cumsum([0, *map(len, parts)])
                return np.array([own[a:b].sum() + b - a - 1 for a, b in zip(edge[:-1], edge[1:])], np.int64)
        self.string, points, begin, end, row = pieces(texts)
        found = self.numbers(points, begin, end)
        return np.bincount(row, self.value[found], len(texts)).astype(np.int64)

    def learn(self, begin: np.ndarray, end: np.ndarray) -> None:
        data = [self.string[a:b].encode() for a, b in zip(begin.tolist(), end.tolist())]
        length = np.array([len(x) for x in data])
        value = self.fst.counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length, length)
        n = self.table.n
        while n + len(value) > len(self.value):
            self.value = np.concatenate([self.value, np.zeros_like(self.value)])
        self.value[n : n + len(value)] = value


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, as the `tokenizers` library counts it.

    `tokenizer` is the path of a byte-level BPE file, readable on every executor. No tokens are added;
    the file's special strings count as one token inside texts. A null text is empty: no bytes, no
    tokens. Every row gives one row, repeated and null ids too.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache("token_counts")
        count = own.get(tokenizer) or own.setdefault(tokenizer, _Counter(tokenizer))
        for b in slices(batches, "text"):
            n = count([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(of, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
