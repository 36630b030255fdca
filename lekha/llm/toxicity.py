"""Toxicity by class-conditional Kneser-Ney language models.

Two models of byte sequences, one of toxic and one of ordinary texts, interpolate orders six to one.
From order three up each class has its own counts, continuation counts below the highest order; the
two lowest orders are shared by both, counted over all texts. What a discount takes from an order's
counts goes to the order below, so a rare expression is rated by shorter ones and in the end by the
counts that both classes share. A text's evidence is the difference of the two log-likelihoods,
normalised by length, over the whole text and over its most toxic stretch; a logistic curve, fitted
on rows that the counts have not seen, turns both into a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekha.llm.shared import bounded_batches
from lekha.llm.text import LOWER, U64, Table, Texts, joined, mix, slices, texts, words, worker_cache

#: Labelled rows of each class that the models learn from, at most; chosen by a hash of the id.
SAMPLE = 2000
#: Longer texts (in characters) do not teach.
LONGEST = 200_000
ORDER, SHARED = 6, 2
DISCOUNT = 0.9
#: Words of a stretch.
STRETCH = 3

_SPLIT = np.ones(256, bool)
_SPLIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, a space after each: (the last six bytes up to each byte as one number, where words begin, where rows' words begin)."""
    t = texts(column)
    low = LOWER[t.data]
    w = words(Texts(low, t.begin), _SPLIT)
    data, to = joined(low, w.start, w.end)
    begin = np.append(to, len(data))[w.first[:-1]]
    since = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if len(data) else np.zeros(0, int)
    code = data.astype(U64)
    for k in range(1, ORDER):  # before a text there are spaces
        back = np.full(len(data), 0x20, U64)
        back[k:] = data[:-k] if k else data
        back[since < k] = 0x20
        code |= back << U64(8 * k)
    return code, to, w.first


def _order(code: np.ndarray, n: int) -> np.ndarray:
    return code & U64((1 << 8 * n) - 1)


def _tally(code: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each class has them."""
    keys, counts = np.zeros(0, U64), np.zeros((2, 0))
    for at in range(0, len(code), 1 << 21):
        k, c = np.unique(code[at : at + (1 << 21)] << U64(1) | label[at : at + (1 << 21)].astype(U64), return_counts=True)
        both, where = np.unique(np.concatenate([keys, k >> U64(1)]), return_inverse=True)
        new = np.zeros((2, len(both)))
        for y in (0, 1):
            new[y] += np.bincount(where[: len(keys)], counts[y], len(both))
            mine = (k & U64(1)) == y
            new[y] += np.bincount(where[len(keys) :][mine], c[mine], len(both))
        keys, counts = both, new
    return keys, counts


class Models:
    """Log-ratios (toxic to ordinary) of all byte sequences that the two models know, by order, and of their back-off."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], curve: np.ndarray):
        self.tables, self.curve = tables, curve
        self.find = []
        for keys, ratio, contexts, back in tables:
            known, before = Table(), Table()
            known.add(mix(keys))
            before.add(mix(contexts))
            self.find.append((known, ratio, before, np.append(back, np.float32(0))))  # the last is for the unknown

    def __reduce__(self):
        return Models, (self.tables, self.curve)

    @classmethod
    def learn(cls, text: pa.Array, toxic: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), discount: float = DISCOUNT) -> Models:
        """Counts from two thirds of the rows, the curve from the rest, each row of a class weighted."""
        fold = np.arange(len(toxic)) % 3 == 0
        learn, rest = np.flatnonzero(~fold), np.flatnonzero(fold)
        code, to, first = _read(text.take(pa.array(learn)))
        edge = np.append(to, len(code))[first]
        label = np.repeat(toxic[learn].astype(int), np.diff(edge))
        counts = {ORDER: _tally(code, label)}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct bytes before
            keys, c = counts[n + 1]
            below, at = np.unique(_order(keys, n), return_inverse=True)
            seen = c > 0 if n + 1 == ORDER else c
            more = np.stack([np.bincount(at, (seen[y] > 0), len(below)) for y in (0, 1)])
            counts[n] = below, more
        tables: list = [None] * (ORDER + 1)
        low = np.full(256, 1 / 256)
        keys_below, p_below = np.arange(256, dtype=U64), np.stack([low, low])
        for n in range(1, ORDER + 1):
            keys, c = counts[n]
            if n <= SHARED:
                c = np.stack([c.sum(0)] * 2)
            contexts, at = np.unique(keys >> U64(8), return_inverse=True)
            total = np.stack([np.bincount(at, c[y], len(contexts)) for y in (0, 1)])
            kept = np.maximum(c - discount, 0)
            saved = np.stack([np.bincount(at, kept[y], len(contexts)) for y in (0, 1)])
            back = np.where(total > 0, (total - saved) / np.maximum(total, 1), 1.0)
            p = kept / np.maximum(total[:, at], 1) + back[:, at] * p_below[:, np.searchsorted(keys_below, _order(keys, n - 1) if n > 1 else keys)]
            ratio = [(np.log(np.maximum(x[1], 1e-30)) - np.log(np.maximum(x[0], 1e-30))).astype(np.float32) for x in (p, back)]
            tables[n] = keys, ratio[0], contexts, ratio[1]
            keys_below, p_below = keys, p
        out = cls(tables[SHARED + 1 :], np.zeros(3))
        out.curve = out._fit(out.features(text.take(pa.array(rest))), toxic[rest], np.where(toxic[rest] == 1, weight[1], weight[0]))
        return out

    def _ratios(self, code: np.ndarray) -> np.ndarray:
        """Each byte's log-ratio after the five before it."""
        out, todo = np.zeros(len(code), np.float32), np.arange(len(code))
        for n in range(ORDER, SHARED, -1):
            known, ratio, before, back = self.find[n - SHARED - 1]
            own = _order(code[todo], n)
            at = known.find(mix(own))
            hit = at >= 0
            out[todo[hit]] += ratio[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            out[todo] += back[before.find(mix(own[~hit] >> U64(8)))]
        return out

    def features(self, text: pa.Array) -> np.ndarray:
        """Of each text: mean log-ratio of a word, and the highest mean in a stretch; zeros without words."""
        code, to, first = _read(text)
        out = np.zeros((len(first) - 1, 2))
        if not len(to):
            return out
        total = np.append(0, np.cumsum(self._ratios(code), dtype=float))[np.append(to, len(code))]
        n = np.diff(first)
        full = np.flatnonzero(n)
        out[full, 0] = (total[first[1:]] - total[first[:-1]])[full] / n[full]
        row_end = np.repeat(first[1:], n)
        last = np.minimum(np.arange(len(to)) + STRETCH, row_end)
        out[full, 1] = np.maximum.reduceat(total[last] - total[:-1], first[:-1][full]) / STRETCH
        return out

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
        """Logistic regression by Newton's method with a slight penalty."""
        x = np.column_stack([x, np.ones(len(x))])
        b, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-4])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
            b = b + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        return b

    def score(self, text: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(text) @ self.curve[:2] + self.curve[2], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Models | None:
    """Models from at most `sample` labelled ids of each class, none with crc32(id as text) divisible by `folds`.

    The curve weighs the classes as all such labelled ids have them. None where a class has no rows. Rows
    with a null id, text or label do not teach, nor do texts of over `longest` characters; an id that
    stands in several rows teaches once, by the least of its texts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two numbers
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample short rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= longest).join(few, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        got = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())]))])
        got = got.sort_by([("toxic", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        toxic = got.column("toxic").to_numpy()
        if len(np.unique(toxic)) == 2:
            text = got.column("text").combine_chunks()
            weight = [total[y] / (toxic == y).sum() for y in (0, 1)]
            model = Models.learn(text, toxic, (weight[0] / max(weight), weight[1] / max(weight)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the bounded sample is one task's input; the tables are read by many
    got = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(of, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def toxicity(docs: DataFrame, models: Models | None, folds: int = 5, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, and the columns `keep` besides.

    score: 0 to 1, higher for likelier toxic; null, empty and wordless texts get the score of no
    evidence. Without models all scores are 0. held_out: crc32(id as text) is divisible by `folds`
    (a null id is not). Every row gives one row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(models)
    others = [c for c in keep if c != text_col]  # the text goes along once
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(others)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        model = sent.value
        for b in slices(batches, "text"):
            score = model.score(b.column("text")) if model else np.zeros(b.num_rows)
            kept = [b.column("text") if c == text_col else b.column(3 + others.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *kept], ["doc_id", "held_out", "score", "predicted", *[f"kept_{i}" for i in range(len(kept))]])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    for i, c in enumerate(keep):
        schema = schema.add(f"kept_{i}", docs.schema[c].dataType)
    return rows.mapInArrow(of, schema).toDF("doc_id", "held_out", "score", "predicted", *keep)
