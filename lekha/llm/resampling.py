"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are there.

All documents and all target texts are counted in hashed buckets; a bucket's gain is a thousand times the
logarithm of the ratio of its smoothed shares. A document weighs the mean gain of its n-grams, and a Gumbel
number made from its id is added, so the highest scores are a draw without replacement by weight.

In a task the n-grams of a stretch of text are interned in an open-addressed table (lekha.llm.interning): its
slots hold buckets and counts, and the slots of the occurrences gather the gains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekha.llm.interning import Interned
from lekha.llm.shared import bounded_batches, written
from lekha.llm.text import LOWER, Texts, joined, slices, texts, words, worker_cache

#: Bytes that no word holds, after A-Z are lower-cased.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Occurrences interned at once.
_STRETCH = 1 << 17
#: Tables of at most so many short rows are sent to all executors in a join.
SMALL = 500_000


def _grams(t: Texts, orders: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, Interned]]]:
    """Each row's number of words; and for stretches of occurrences their rows and their table."""
    low = LOWER[t.data]
    w = words(Texts(low, t.begin), NOT_WORD)
    data, start, end = low, w.start, w.end
    if orders > 1:
        data, start = joined(low, w.start, w.end)
        end = start + w.end - w.start

    def each() -> Iterator[tuple[np.ndarray, Interned]]:
        for n in range(1, orders + 1):
            for a in range(0, len(start) - n + 1, _STRETCH):
                first = np.arange(a, min(a + _STRETCH, len(start) - n + 1))
                first = first[w.row[first] == w.row[first + n - 1]]
                yield w.row[first], Interned(data, start[first], end[first + n - 1], buckets)

    return np.diff(w.first), each()


def bucket_counts(docs: DataFrame, orders: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n): occurrences of all runs of 1 to `orders` words in all texts, by bucket; buckets without any are left out.

    A-Z are lower-cased, words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, a run's words are joined by one space and its
    bucket is the crc32 of its bytes modulo `buckets`. A null text has none. A task gives a row a bucket at most.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("resampling")
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            for _, x in _grams(texts(b.column("text")), orders, buckets)[1]:
                total += np.bincount(x.bucket[x.used], x.count[x.used], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(of, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """Each bucket's floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))): 8 bytes a bucket on the driver, however many texts."""
    own, far = ({r.bucket: r.n for r in bucket_counts(df, orders, buckets, text_col).collect()} for df in (docs, target))
    s_all, t_all = float(sum(own.values()) + buckets), float(sum(far.values()) + buckets)
    return np.array([math.floor(1000 * math.log((far.get(k, 0) + 1.0) * s_all / ((own.get(k, 0) + 1.0) * t_all))) for k in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): of each document the floored mean of its n-grams' gains, 0 without any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("resampling")
        for b in slices(batches, "text"):
            n_words, each = _grams(texts(b.column("text")), orders, len(gain))
            n, total = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for row, x in each:
                of_slot = np.zeros(len(x.bucket), np.int64)
                of_slot[x.used] = gain[x.bucket[x.used]]
                n += np.bincount(row, minlength=len(n))
                total += np.bincount(row, of_slot[x.slot], len(n)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of `seed:doc_id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, orders: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document, those drawn with their rank from 1.

    Of all N documents with at least `least_words` words and an id, floor(percent N / 100) are drawn: the highest
    scores, ties to the smaller id, then to the larger weight and number of n-grams. A null text has no words.
    A row without an id counts in the statistics; it has no score and is never drawn. Repeated rows are drawn
    each for itself. An empty table gives no rows, an empty target hits no bucket.
    """
    rows = weights(docs, gains(docs, target, orders, buckets, text_col), orders, id_col, text_col)
    rows = written(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id"), F.col("weight").desc(), F.col("n_features").desc()]
    # a global rank without one task: ranges of scores, places inside them, and the sizes of the ranges before
    ranged = rows.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = written(ranged.select("doc_id", "n_features", "weight", "score", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place")), "ranges")
    sizes = ranged.groupBy("part").count()
    base = written(sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"), F.sum("count").over(Window.partitionBy()).alias("all")), "bases")
    drawn = ranged.join(F.broadcast(base) if base.count() <= SMALL else base, "part")
    rank = F.col("base") + F.col("place") + 1
    drawn = drawn.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.floor(F.lit(percent) * F.col("all") / 100), rank).alias("rank"))
    return drawn.unionByName(rows.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 by bytes, for DuckDB: the CTE of its table, and the value of a string of UTF-8.
CRC_TABLE = """RECURSIVE crc_step AS (
  SELECT i AS k, i AS c, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_step WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY k) AS crc FROM crc_step WHERE n = 8)"""


def crc32_sql(x: str) -> str:
    """crc32 of the expression, where crc_table is joined."""
    code = f"[CAST('0x' || hex(encode({x}))[2 * j - 1:2 * j] AS BIGINT) FOR j IN range(1, octet_length(encode({x})) + 1)]"
    return f"xor(list_reduce({code}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


#: The query by counting every word, for DuckDB.
SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
o AS (SELECT doc_id, unnest(w) AS x FROM d),
v AS (SELECT x, {crc32_sql('x')} % 10000 AS bucket FROM (SELECT DISTINCT x FROM o UNION SELECT unnest(w) FROM b), crc_table),
s AS (SELECT bucket, count(*) AS n FROM o JOIN v USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) JOIN v USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM o JOIN v USING (x) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) AS n_words,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM r)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS BIGINT) AS rank FROM k
"""
