"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once; at each position its output links give every piece that ends there,
and each relaxes the best score of the position: a Viterbi search over the lattice of pieces.
Scores alone choose for unigram models. A byte-pair model's result is not the highest sum of scores,
so there a piece relaxes a position only if it fits the piece before it, that is if the merges of the
two, run side by side, never join their border. Exactly one path fits, and it is the model's own.

Texts are cut before each run of word-begin marks, where no piece crosses; each distinct stretch is
searched once for as long as the worker's table has room. New stretches of a batch go through the
automaton side by side, a character of each at a time; long ones and those with characters that no
piece has go one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekha.llm.pretoken import IdCache
from lekha.llm.shared import bounded_batches
from lekha.llm.text import U64, Table, mix, ragged, slices, worker_cache

MARK = "▁"
_EDGE = "\ud800"  # no text holds a lone surrogate


#: Longer stretches are searched one by one.
_SHORT, _SIDE = 48, 1 << 15


class Automaton:
    """Aho-Corasick over strings of characters, stepped for many texts at once; transitions are compiled when first met."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, p in enumerate(pieces):
            node = 0
            for c in map(ord, p):
                new = self.next[node].get(c)
                if new is None:
                    new = self.next[node][c] = len(self.next)
                    self.next.append({})
                    piece.append(-1)
                node = new
            piece[node] = i
        self.fail, hit, more = [0] * len(self.next), [0] * len(self.next), [0] * len(self.next)
        row = [0]
        while row:  # level by level
            below = []
            for node in row:
                for c, new in self.next[node].items():
                    self.fail[new] = self._from(self.fail[node], c) if node else 0
                    more[new] = hit[self.fail[new]]
                    hit[new] = new if piece[new] >= 0 else more[new]
                    below.append(new)
            row = below
        #: Of each state: the piece that ends in it, the first state of its output links, and the next one of such a state; 0 is none.
        self.piece, self.hit, self.more = np.array(piece), np.array(hit), np.array(more)
        self.table, self.to = Table(), np.zeros(1 << 16, np.int64)

    def _from(self, node: int, c: int) -> int:
        while node and c not in self.next[node]:
            node = self.fail[node]
        return self.next[node].get(c, 0)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = state.astype(U64) << U64(21) | char.astype(U64)
        at = self.table.find(mix(key))
        if (at < 0).any():
            new = np.unique(key[at < 0])
            n = self.table.n
            while n + len(new) > len(self.to):
                self.to = np.concatenate([self.to, np.zeros_like(self.to)])
            self.to[n : n + len(new)] = [self._from(k >> 21, k & 0x1FFFFF) for k in new.tolist()]
            self.table.add(mix(new))
            at = self.table.find(mix(key))
        return self.to[at]


class Model(IdCache):
    """kind: "bpe" or "unigram", as the model file was trained. Identity normalisation, with a mark put before every text."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        super().__init__(300_000)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.unk = kind, sp.unk_id()
        every = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in every]
        plain = [i for i in every if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.number = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in every if sp.is_byte(i)}
        self.least = min(self.score.values(), default=0.0) - 10  # what an unknown character scores in a unigram model
        self.whole = any(MARK in p.lstrip(MARK) for p in self.number)  # then stretches cannot be cut at marks
        self.automaton: ahocorasick.Automaton | None = None  # built when first needed; decoding does not
        self._history: dict[str, tuple] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._built: set[str] = set()
        self._side: Automaton | None = None
        control = {i for i in every if sp.is_control(i)}
        back = {i: bytes([b]) for b, i in self.byte.items()}
        data = [b"" if i in control else back.get(i) or (" ⁇ " if i == self.unk else self.pieces[i].replace(MARK, " ")).encode() for i in every]
        self.length = np.array([len(x) for x in data])
        self.begin, self.data = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(data), np.uint8)

    def _merges(self, piece: str) -> tuple:
        """(score, first symbol, last symbol) after each merge that builds the piece, and the symbols before."""
        if (known := self._history.get(piece)) is None:
            symbols, events = list(piece), []
            while len(symbols) > 1:
                best, at = None, -1
                for k in range(len(symbols) - 1):
                    s = self.score.get(symbols[k] + symbols[k + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, k
                if best is None:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                events.append((best, symbols[0], symbols[-1]))
            known = self._history[piece] = piece[0], piece[-1], events, len(symbols) == 1
        return known

    def fits(self, a: str, b: str) -> bool:
        """No merge joins the end of a and the begin of b: the better score goes first, then the one further left."""
        _, end, left, _ = self._merges(a)
        begin, _, right, _ = self._merges(b)
        i = j = 0
        while True:
            across = self.score.get(end + begin)
            x = left[i][0] if i < len(left) else None
            y = right[j][0] if j < len(right) else None
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is None and y is None:
                return True
            if y is None or (x is not None and x >= y):
                end, i = left[i][2], i + 1
            else:
                begin, j = right[j][1], j + 1

    def _check(self, a: str, b: str) -> bool:
        """fits, remembered."""
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            known = self._fits[a, b] = self.fits(a, b)
        return known

    def _automaton(self) -> ahocorasick.Automaton | None:
        if self.automaton is None and self.number:
            self.automaton = ahocorasick.Automaton()
            for piece in self.number:
                self.automaton.add_word(piece, piece)
            self.automaton.make_automaton()
            self._built = {p for p in self.number if self._merges(p)[3]}  # pieces that merges build
        return self.automaton

    def _fitting(self, text: str) -> list[str]:
        """For each end in the text the one piece that fits the pieces before it, or an empty string."""
        automaton = self._automaton()
        last, done, known, built, check = [""] * (len(text) + 1), 0, self._fits, self._built, self._check
        for at, piece in automaton.iter(text) if automaton else ():
            if done < at:
                self._alone(text, last, done, at)
                done = at
            end = at + 1
            if last[end]:
                continue
            begin = end - len(piece)
            if begin:
                before = last[begin]
                if not before or not (known[before, piece] if (before, piece) in known else check(before, piece)):
                    continue
            if piece in built:
                last[end] = piece
        self._alone(text, last, done, len(text))
        return last

    def _alone(self, text: str, last: list[str], begin: int, end: int) -> None:
        """Ends that no piece reaches are reached by the character before them."""
        for at in range(begin, end):
            if not last[at + 1] and (not at or last[at] and self._check(last[at], text[at])):
                last[at + 1] = text[at]

    def _best(self, text: str) -> list[str]:
        """For each end in the text the last piece of the best sum of scores up to there."""
        best: list[float | None] = [None] * (len(text) + 1)
        last, done = [""] * (len(text) + 1), 0
        best[0] = 0.0

        def relax(piece: str, end: int, value: float) -> None:
            before = best[end - len(piece)]
            if before is not None and (best[end] is None or before + value > best[end]):
                best[end], last[end] = before + value, piece

        automaton = self._automaton()
        for at, piece in automaton.iter(text) if automaton else ():
            while done < at:
                done += 1
                if best[done] is None:
                    relax(text[done - 1], done, self.least)
            relax(piece, at + 1, self.score[piece])
        while done < len(text):
            done += 1
            if best[done] is None:
                relax(text[done - 1], done, self.least)
        return last

    def search(self, text: str) -> list[int]:
        """Ids of one stretch, marks included."""
        last, number = self._fitting(text) if self.kind == "bpe" else self._best(text), self.number
        n, out = len(text), []
        while n:
            piece = last[n]
            n -= len(piece)
            if piece in number:
                out.append(number[piece])
            elif self.byte:
                out.extend(self.byte[b] for b in reversed(piece.encode()))
            else:
                out.append(self.unk)
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids)."""
        string = _EDGE + "".join(f"{MARK}{x}{_EDGE}" if x else _EDGE for x in texts).replace(" ", MARK)
        points = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = points == ord(_EDGE)
        start = edge.copy()
        start[1:] |= edge[:-1]
        if not self.whole:
            mark = points == ord(MARK)
            start[1:] |= mark[1:] & ~mark[:-1]
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(points))
        row = np.cumsum(edge[begin]) - 1
        keep = ~edge[begin]
        begin, end, row = begin[keep], end[keep], row[keep]
        self.string, self.points = string, points
        return self.ids(self.numbers(points, begin, end), row, len(texts))

    def learn(self, begin: np.ndarray, end: np.ndarray) -> None:
        if self.kind == "bpe":
            if self._side is None:
                self.built = [p for p in self.number if self._merges(p)[3]]  # the pieces that merges build
                self.wide = np.array([len(p) for p in self.built], np.int64)
                self.id = np.array([self.number[p] for p in self.built], np.uint32)
                self.single = np.zeros(0x110000, bool)  # characters that are pieces, and those in no piece
                self.single[:] = True
                self.single[[ord(c) for c in {c for p in self.number for c in p} - {p for p in self.built if len(p) == 1}]] = False
                self.alone = self.single.copy()
                self.alone[[ord(p) for p in self.built if len(p) == 1]] = False
                self._side, self.pairs, self.pair_fits = Automaton(self.built), Table(), np.zeros(1 << 16, bool)
            count = np.zeros(len(begin), np.int64)
            known = np.append(0, np.cumsum(self.single[self.points]))
            short = (end - begin <= _SHORT) & (known[end] - known[begin] == end - begin)
            order = np.flatnonzero(short)
            order = order[np.argsort((begin - end)[order], kind="stable")]
            flat, to = [], 0
            place = np.zeros(len(begin), np.int64)
            for at in range(0, len(order), _SIDE):
                own = order[at : at + _SIDE]
                n, got = self._side_by_side(begin[own], end[own])
                count[own], place[own] = n, to + np.cumsum(n) - n
                flat.append(got)
                to += len(got)
            for i in np.flatnonzero(~short).tolist():
                got = np.array(self.search(self.string[begin[i] : end[i]]), np.uint32)
                count[i], place[i] = len(got), to
                flat.append(got)
                to += len(got)
            self.keep(count, np.concatenate([np.zeros(0, np.uint32), *flat])[ragged(place, count)])
        else:
            ids = [self.search(self.string[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
            self.keep(np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32))

    def _all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits for pairs of built pieces, by their places in that list."""
        key = a.astype(U64) << U64(32) | b.astype(U64)
        at = self.pairs.find(mix(key))
        if (at < 0).any():
            new = np.unique(key[at < 0])
            if self.pairs.n + len(new) > 4_000_000:
                self.pairs, self.pair_fits, new = Table(), np.zeros(1 << 16, bool), np.unique(key)
            n = self.pairs.n
            while n + len(new) > len(self.pair_fits):
                self.pair_fits = np.concatenate([self.pair_fits, np.zeros_like(self.pair_fits)])
            self.pair_fits[n : n + len(new)] = [self.fits(self.built[k >> 32], self.built[k & 0xFFFFFFFF]) for k in new.tolist()]
            self.pairs.add(mix(new))
            at = self.pairs.find(mix(key))
        return self.pair_fits[at]

    def _side_by_side(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, all ids) of stretches by descending length, each of whose characters is a piece or in no piece."""
        length, auto, many = end - begin, self._side, len(self.built)
        last, state = np.full((len(begin), int(length[0]) + 1), -1, np.int32), np.zeros(len(begin), np.int64)
        for k in range(int(length[0])):
            n = int(np.searchsorted(-length, -k, "left"))  # those longer than k
            char = self.points[begin[:n] + k]
            state[:n] = auto.step(state[:n], char)
            odd = np.flatnonzero(self.alone[char])  # joins nothing, so it always fits
            last[odd, k + 1] = many + char[odd]
            node = auto.hit[state[:n]]
            todo = np.flatnonzero(node)
            node = node[todo]
            while len(todo):  # along the output links, until a piece fits
                p = auto.piece[node]
                at = k + 1 - self.wide[p]
                before = last[todo, at]
                ok = at == 0
                ok |= before >= many
                far = np.flatnonzero((before >= 0) & ~ok)
                ok[far] = self._all_fit(before[far], p[far])
                last[todo[ok], k + 1] = p[ok]
                rest = np.flatnonzero(~ok)
                node = auto.more[node[rest]]
                todo, node = todo[rest][node > 0], node[node > 0]
        place, row, rows, got = length.copy(), np.arange(len(begin)), [], []
        while len(row):  # back from the end
            p = last[row, place[row]]
            rows.append(row), got.append(p)
            place[row] -= np.where(p < many, self.wide[np.minimum(p, many - 1)], 1)
            row = row[place[row] > 0]
        rows, got = np.concatenate(rows[::-1]), np.concatenate(got[::-1])
        order = np.argsort(rows, kind="stable")
        rows, got = rows[order], got[order]
        odd = np.flatnonzero(got >= many)
        out = self.id[np.minimum(got, many - 1)]
        if not len(odd):
            return np.bincount(rows, minlength=len(begin)), out
        ids = {c: [self.byte[b] for b in chr(c).encode()] if self.byte else [self.unk] for c in np.unique(got[odd] - many).tolist()}
        wide = np.ones(len(got), np.int64)
        wide[odd] = [len(ids[c]) for c in (got[odd] - many).tolist()]
        to = np.cumsum(wide) - wide
        out = np.repeat(out, wide)
        out[ragged(to[odd], wide[odd])] = [i for c in (got[odd] - many).tolist() for i in ids[c]]
        return np.bincount(np.repeat(rows, wide), minlength=len(begin)), out

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of ids; the mark put before a text goes, and bytes that are no UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        data = self.data[ragged(self.begin[ids], self.length[ids])].tobytes()
        to = np.append(0, np.cumsum(self.length[ids]))[np.append(0, np.cumsum(counts))].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(to[:-1], to[1:])]
        return [x[1:] if x[:1] == " " else x for x in out]


def _model(path: str, kind: str) -> Model:
    own = worker_cache("sentence_pieces")
    return own.get((path, kind)) or own.setdefault((path, kind), Model(path, kind))


def encode(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, ids_crc32) of every whole text, without begin or end tokens; `back` adds what the ids decode to, as `decoded`.

    `model` is the path of a SentencePiece file, readable on every executor. Null and empty texts have
    no ids; every row gives one, null and repeated ids too. ids_crc32 is that of the ids as
    little-endian 32-bit integers.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model, kind)
        for b in slices(batches, "text"):
            count, ids = own.encode([x or "" for x in b.column("text").to_pylist()])
            to = np.append(0, np.cumsum(count)).astype(np.int32)
            flat = ids.astype("<i4")
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(to[:-1].tolist(), to[1:].tolist())]
            out = {"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(to), pa.array(flat)), "ids_crc32": pa.array(crc, pa.int64())}
            if back:
                out["decoded"] = pa.array(own.decode(count, ids), pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, ids array<int>, ids_crc32 long" + ", decoded string" * back)


def decode(encoded: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """The rows with their `ids` (array<int>; null: none) turned back into `decoded` texts.

    Ids that are null or no number of a piece give no text; a column `decoded` that is there already
    gives way.
    """
    rows = encoded.drop("decoded")
    names = rows.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = b.column(names.index("ids"))
                row = np.repeat(np.arange(len(ids)), [len(x) if x.is_valid else 0 for x in ids])
                flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
                good = (flat >= 0) & (flat < len(own.pieces))
                out = own.decode(np.bincount(row[good], minlength=len(ids)), flat[good])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(of, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
