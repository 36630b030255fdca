"""A hashed maximum-entropy language model with a class-factored softmax.

The next token's class is predicted by a softmax over hashed features of the history: the last word,
the last word with the class of the third last (a skip), and the last three classes. A second softmax
over the last word, the last two words and the class predicts the cell inside it. Frequent tokens
share head classes and have a cell each. All other words fall into tail classes by their last two bytes
and into cells by their hash; inside a cell they are told apart by their counts in the training texts,
plus one, with one place for all words not met there. So the probabilities of all tokens sum to one
after any history.

What is gathered grows with the corpus: the counts of all its words, and the table of feature rows,
whose size follows the number of different words (`table_rows`).

Training goes in rounds, each over another part of the training texts. In a round every task starts
from the same weights and updates its own by row-wise AdaGrad; their changes and sums of squares are
averaged, level by level, and the next round goes on from there. Scoring: documents and the counts of
their words meet in blocks, where sparse rows are gathered by numpy. Words are known by two 64-bit
hashes: should two share the first, all is hashed anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.shared import written
from lekha.llm.text import LOWER, U64, Table, Texts, mix, slices, texts, word_hash, words

HEAD_CLASSES, IN_CLASS, TAIL_CLASSES = 8, 16, 24
CLASSES = HEAD_CLASSES + TAIL_CLASSES
RATE, ROUNDS = 0.7, 4
_BATCH, _SHARDS, _FAN = 16384, 16, 32
#: The features that choose a class and a cell, of: the last word, the last two, the skip, the last classes.
_CLASS, _CELL = (0, 2, 3), (0, 1)
#: Each learner of a round reads so many times its table's size of text, about.
_TEXT_A_TABLE = 1
#: Learners of a round, at least.
_LEARNERS = 4
#: Text of a task that scores, in bytes, about, and blocks that it holds.
TASK_BYTES, _BLOCKS = 24 << 20, 1
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_SALTS = [U64(x) for x in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xF1357AEA2E62A9C5)]


def table_rows(types: int) -> int:
    """Rows of the feature table for so many different words: a power of two that grows with their root, 16,384 at least."""
    return 1 << max(14, round(math.log2(64 * math.sqrt(max(1, types)))))


class Tokens(NamedTuple):
    hash: np.ndarray  # of each token, an end after each text
    check: np.ndarray  # another hash of it
    tail: np.ndarray  # the class of its spelling
    first: np.ndarray  # text r has the tokens first[r]:first[r + 1]


def tokens(column: pa.Array, seed: int = 0, checked: bool = True) -> Tokens:
    t = texts(column)
    low = LOWER[t.data]
    w = words(Texts(low, t.begin))
    h = word_hash(low, w.start, w.end, 2 * seed)
    check = word_hash(low, w.start, w.end, 2 * seed + 1) if checked else h
    last = low[w.end - 1].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    before = np.where(w.end - w.start > 1, low[w.end - 2], 0).astype(np.int64) if len(h) else last
    tail = HEAD_CLASSES + ((last * 257 + before) * 2654435761 % (1 << 32) >> 16) % TAIL_CLASSES
    at = w.first[1:]
    return Tokens(np.insert(h, at, END), np.insert(check, at, END), np.insert(tail, at, 0), w.first + np.arange(len(w.first)))


def cell(hashes: np.ndarray) -> np.ndarray:
    """A rare word's place in its class."""
    return ((hashes >> U64(40)) % U64(IN_CLASS)).astype(np.int64)


class Spec(NamedTuple):
    """What the counts say: everything that training and scoring share but the weights."""

    head: np.ndarray  # hashes of the frequent tokens, class by class
    bias: np.ndarray  # log of the classes' shares
    inner: np.ndarray  # log of the shares of the cells inside each class
    total: np.ndarray  # of each cell of a tail class: its words' counts, plus their number, plus one
    tokens: int
    types: int


class Model:
    def __init__(self, spec: Spec):
        self.spec, self.size = spec, table_rows(spec.types)
        self.w, self.v = np.zeros((self.size, CLASSES), np.float32), np.zeros((self.size, IN_CLASS), np.float32)
        self.heads = Table()
        self.heads.add(spec.head)
        self.filled = np.ones((CLASSES, IN_CLASS), bool)
        self.filled[:HEAD_CLASSES] = np.arange(HEAD_CLASSES * IN_CLASS).reshape(HEAD_CLASSES, IN_CLASS) < len(spec.head)

    def places(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class and its cell in it."""
        at = self.heads.find(t.hash)
        return np.where(at >= 0, at // IN_CLASS, t.tail), np.where(at >= 0, at % IN_CLASS, cell(t.hash))

    @staticmethod
    def features(t: Tokens, cls: np.ndarray) -> list[np.ndarray]:
        """For each feature the hash of its value at each token."""
        n, place, back = len(t.hash), np.arange(len(t.hash)) - np.repeat(t.first[:-1], np.diff(t.first)), []
        for k, of, start in ((1, t.hash, START), (2, t.hash, START), (1, cls, CLASSES), (2, cls, CLASSES), (3, cls, CLASSES)):
            h = np.full(n, start, U64)
            h[k:] = of[:-k]
            h[place < k] = start
            back.append(h)
        a, b, *kinds = back
        values = a, a * U64(3) + b, a * U64(5) + kinds[2], (kinds[0] * U64(64) + kinds[1]) * U64(64) + kinds[2]
        return [mix(x ^ s) for x, s in zip(values, _SALTS)]

    def _rows(self, feature: np.ndarray) -> np.ndarray:
        return (feature & U64(self.size - 1)).astype(np.uint16 if self.size <= 1 << 16 else np.uint32)

    def _class_rows(self, feature: list[np.ndarray]) -> list[np.ndarray]:
        return [self._rows(feature[k]) for k in _CLASS]

    def _cell_rows(self, feature: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
        own = cls.astype(U64) * U64(0x9E3779B97F4A7C15)
        return [self._rows(mix(feature[k] + own)) for k in _CELL]

    @staticmethod
    def _softmax(rows: list[np.ndarray], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = table[rows[0]]
        for r in rows[1:]:
            z += table[r]
        z += bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def _inner(self, rows: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        return self._softmax(rows, self.v, np.where(self.filled, self.spec.inner, np.float32(-1e30))[cls])

    def log10(self, t: Tokens, counts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; counts: of each in the training texts."""
        cls, place = self.places(t)
        features, out = self.features(t, cls), np.zeros(len(cls))
        for at in range(0, len(cls), _BATCH):
            feature, c, s = [f[at : at + _BATCH] for f in features], cls[at : at + _BATCH], place[at : at + _BATCH]
            line = np.arange(len(c))
            p = self._softmax(self._class_rows(feature), self.w, self.spec.bias)[line, c]
            q = self._inner(self._cell_rows(feature, c), c)[line, s]
            got = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30))
            tail = np.flatnonzero(c >= HEAD_CLASSES)
            got[tail] += np.log10((counts[at : at + _BATCH][tail] + 1) / self.spec.total[c[tail] - HEAD_CLASSES, s[tail]])
            out[at : at + _BATCH] = got
        return out

    def learn(self, t: Tokens, sums: tuple[np.ndarray, np.ndarray]) -> None:
        """One pass of gradient updates; sums: squared gradients of each row so far."""
        cls, place = self.places(t)
        features = self.features(t, cls)
        for at in range(0, len(cls), _BATCH):
            feature, c = [f[at : at + _BATCH] for f in features], cls[at : at + _BATCH]
            line = np.arange(len(c))
            for table, square, rows, goal in ((self.w, sums[0], self._class_rows(feature), c), (self.v, sums[1], self._cell_rows(feature, c), place[at : at + _BATCH])):
                g = self._softmax(rows, table, self.spec.bias) if table is self.w else self._inner(rows, c)
                g[line, goal] -= 1
                self._update(table, square, rows, g)

    @staticmethod
    def _update(table: np.ndarray, sums: np.ndarray, rows: list[np.ndarray], g: np.ndarray) -> None:
        lanes = np.ascontiguousarray(g.T, dtype=np.float64)
        for r in rows:
            order = np.argsort(r, kind="stable" if r.itemsize == 2 else None)
            own = r[order]
            first = np.append(True, own[1:] != own[:-1])
            number = np.empty(len(r), np.int64)
            number[order] = np.cumsum(first) - 1
            own = own[first]
            total = np.stack([np.bincount(number, lane, len(own)) for lane in lanes]).T.astype(np.float32, order="C")
            sums[own] += np.einsum("ij,ij->i", total, total)
            total *= (RATE / len(rows) / np.sqrt(sums[own] / table.shape[1] + np.float32(1e-3)))[:, None]
            table[own] -= total


def _counts(rows: DataFrame, seed: int) -> DataFrame:
    """(hash, check, tail, n, clash): how often each token stands in the training texts, and whether words share its hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tails, checks, many = Table(), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)

        def row(hashes, check, tail, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(check.view(np.int64)), pa.array(tail), pa.array(n)], ["hash", "check", "tail", "n"])

        def out() -> pa.RecordBatch:
            slot = np.flatnonzero(known.at >= 0)
            at = known.at[slot]
            return row(known.keys[slot], checks[at], tails[at], many[at])

        for b in slices(batches, "text"):
            t = tokens(b.column("text"), seed)
            at = known.find(t.hash)
            miss = np.flatnonzero(at < 0)
            new, first = np.unique(t.hash[miss], return_index=True)
            known.add(new)
            tails, checks = np.append(tails, t.tail[miss[first]]), np.append(checks, t.check[miss[first]])
            at[miss] = known.find(t.hash[miss])
            odd = np.flatnonzero(checks[at] != t.check)
            if len(odd):
                yield row(t.hash[odd], t.check[odd], t.tail[odd], np.zeros(len(odd), np.int64))
            now = np.bincount(at, minlength=known.n)
            now[: len(many)] += many
            many = now
            if known.n > 400_000:
                yield out()
                known, tails, checks, many = Table(), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        yield out()

    parts = rows.where("not held_out").select("text").mapInArrow(of, "hash long, check long, tail long, n long")
    merged = parts.groupBy("hash").agg(F.min("check").alias("check"), F.max("check").alias("other"), F.first("tail").alias("tail"), F.sum("n").alias("n"))
    return merged.select("hash", "check", "tail", "n", (F.col("check") != F.col("other")).alias("clash"))


def _spec(counts: DataFrame) -> Spec:
    end = int(END.astype(np.int64))
    top = counts.orderBy((F.col("hash") != end), F.desc("n"), "hash").limit(HEAD_CLASSES * IN_CLASS).collect()
    top.sort(key=lambda r: (-r.n, r.hash))
    place = F.pmod(F.shiftrightunsigned("hash", 40), F.lit(IN_CLASS)).cast("int")
    types, many = np.zeros((CLASSES, IN_CLASS), np.int64), np.zeros((CLASSES, IN_CLASS), np.int64)
    for r in counts.groupBy("tail", place.alias("cell")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect():  # a fixed number of cells
        types[r.tail, r.cell], many[r.tail, r.cell] = r.types, r.n
    known, seen = int(types.sum()), int(many.sum())
    rare, rare_types = many.copy(), types.copy()
    share = np.zeros((CLASSES, IN_CLASS))
    head = np.array([r.hash for r in top], np.int64).view(U64)
    for i, r in enumerate(top):
        share[i // IN_CLASS, i % IN_CLASS] = r.n
        c = int(cell(head[i : i + 1])[0])
        rare[r.tail, c] -= r.n
        rare_types[r.tail, c] -= 1
    total = (rare + rare_types)[HEAD_CLASSES:] + 1.0
    share[HEAD_CLASSES:] = total - 0.5
    classes = share.sum(1)
    classes[classes == 0] = 1e-30  # a class without tokens
    inner = np.log(np.maximum(share, 1e-30) / np.maximum(classes, 1e-30)[:, None]).astype(np.float32)
    return Spec(head, np.log(classes / classes.sum()).astype(np.float32), inner, total, seen, known)


def _mean(table):
    """Averages of packed float16 numbers, by what each task has seen."""
    seen = table.column("seen").to_numpy()
    out = sum(np.frombuffer(x.as_buffer(), np.float16).astype(np.float32) * np.float32(n / seen.sum()) for x, n in zip(table.column("part"), seen))
    return pa.table({"task": [table.column("task")[0].as_py() // _FAN], "shard": [table.column("shard")[0].as_py()], "seen": [float(seen.sum())], "part": pa.array([out.astype(np.float16).tobytes()], pa.binary())})


def train(rows: DataFrame, spec: Spec, text_bytes: int, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Weights from `rounds` rounds, each averaged over its tasks by the tokens that each has seen.

    The tables sent come to a fixed share of the texts (of so many bytes), whatever the table's size.
    """
    spark, model = rows.sparkSession, Model(spec)
    square = np.zeros((model.size, 2), np.float32)
    schema = "task long, shard long, seen double, part binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((spec, model.w, model.v, square))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, seen, kept = None, 0, sent.value
            for b in slices(batches, "text"):
                if own is None:
                    own = Model(kept[0])
                    own.w, own.v = kept[1].copy(), kept[2].copy()
                    sums = kept[3][:, 0].copy(), kept[3][:, 1].copy()
                t = tokens(b.column("text"), seed, False)
                own.learn(t, sums)
                seen += len(t.hash)
            if seen:
                # sums of squares go as roots, which float16 can hold
                both = np.hstack([own.w - kept[1], own.v - kept[2], np.minimum(np.sqrt(np.stack(sums, 1)), 60_000)]).astype(np.float16)
                for s, part in enumerate(np.split(both, _SHARDS)):
                    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([s]), pa.array([float(seen)]), pa.array([part.tobytes()], pa.binary())], ["task", "shard", "seen", "part"])

        learning = rows.where("not held_out").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn).select("text")
        tasks = max(1, min(learning.rdd.getNumPartitions(), max(_LEARNERS, text_bytes // rounds // (_TEXT_A_TABLE * 4 * model.size * (CLASSES + IN_CLASS)))))
        parts = learning.coalesce(tasks).mapInArrow(of, schema)
        while True:
            parts = parts.groupBy(F.floor(F.col("task") / _FAN).alias("level"), "shard").applyInArrow(_mean, schema)
            if tasks <= _FAN:
                break
            tasks = -(-tasks // _FAN)
        got = sorted(parts.collect(), key=lambda r: r.shard)  # one row for each of a fixed number of shards
        sent.unpersist()
        if got:
            both = np.concatenate([np.frombuffer(r.part, np.float16) for r in got]).reshape(model.size, -1).astype(np.float32)
            model.w, model.v = model.w + both[:, :CLASSES], model.v + both[:, CLASSES:-2]
            square = both[:, -2:] ** 2
    return model


def scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from the texts whose crc32(id as text) modulo `folds` is not `held`. A-Z are
    lower-cased; tokens are the words `[^\\x20\\x09-\\x0D]+` and an end. base_score: the sum of
    log10((c + 1) / (N + V + 1)) with the tokens' training counts; score: the model's log10
    probability of the text. A null text is empty and has its end only. Rows with a null id are left
    out; repeated ids stay. Without training texts both scores come from no counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = rows.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % folds == held)
    for seed in range(100):
        counts = written(_counts(rows, seed), "counts")
        if not counts.where("clash").limit(1).count():
            break
    spec = _spec(counts)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = spark.sparkContext.broadcast(_state(train(rows, spec, size, seed=seed)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_BLOCKS * tasks))
    dealt = rows.select("doc_id", "held_out", "text", block.alias("block")).repartition(tasks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Table] = {}
        for whole in batches:
            block = whole.column("block").to_numpy()
            for k in np.unique(block).tolist():
                table = known.setdefault(k, Table())
                for b in slices(iter([whole.filter(pa.array(block == k))]), "text"):
                    h = tokens(b.column("text"), seed, False).hash
                    table.add(np.unique(h[table.find(h) < 0]))
        for k, table in known.items():
            keys = table.keys[table.at >= 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k)), pa.array(keys)], ["block", "hash"])

    need = dealt.mapInArrow(distinct, "block long, hash long").join(counts.select("hash", "check", "n"), "hash").select(F.col("block").alias("of"), "hash", "check", "n")

    def meet(left, right):
        spec, w, v = sent.value
        model = Model(spec)
        model.w, model.v = w, v
        known = Table()
        known.add(right.column("hash").to_numpy().view(U64))
        many, checks = np.append(right.column("n").to_numpy(), 0), np.append(right.column("check").to_numpy().view(U64), U64(0))
        out = []
        for b in slices(iter(left.combine_chunks().to_batches()), "text"):
            t = tokens(b.column("text"), seed)
            at = known.find(t.hash)
            c = np.where(checks[at] == t.check, many[at], 0)  # a word not met in training may share a hash
            add = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every text has its end
            base = np.log10((c + 1) / (spec.tokens + spec.types + 1))
            out.append(pa.table({
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": np.diff(t.first), "n_known": add((c > 0).astype(np.int64)),
                "train_tokens": np.full(b.num_rows, spec.tokens, np.int64), "base_score": add(base), "score": add(model.log10(t, c)),
            }))
        schema = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        return pa.concat_tables([x.cast(pa.schema(schema)) for x in out]) if out else pa.Table.from_pylist([], pa.schema(schema))

    return dealt.groupBy("block").cogroup(need.groupBy("of")).applyInArrow(meet, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _state(model: Model) -> tuple[Spec, np.ndarray, np.ndarray]:
    return model.spec, model.w, model.v
