"""Exact substring duplicates by super-k-mers.

Every window of `window` consecutive words belongs to the bucket of its minimiser, the least hash of
the `gram`-word runs inside it. Consecutive windows of a document with one minimiser travel as one
string (a super-k-mer) to that bucket, so a word is sent about three times and not `window` times,
and equal windows always meet. There all windows are sorted and each but the first is a repeat. Hashes
only bring words and windows together; equal they are when their bytes are.

Equal super-k-mers of one slice of documents are settled where they are read: only the first is sent.
Those that repeat in a slice are remembered by the task, which sends them again only for an earlier
document; so a passage that many documents share comes to its bucket about once for each task, not for each document.

A line that many documents have between different neighbours gives each of them other super-k-mers of
one minimiser. Words are therefore counted by minimiser first; windows of one with more than HOT_WORDS
travel singly, to the bucket of the hash of all their words, where equal windows meet as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekha.llm.shared import bounded_batches, written
from lekha.llm.text import U64, Texts, Words, gram_hash, joined, mix, ragged, same_bytes, slices, span_hash, texts, word_numbers, words, worker_cache

#: Tables of at most so many rows of 16 bytes are sent to all executors in a join.
SMALL = 500_000
#: About so many sent words to a bucket.
BUCKET_WORDS = 1_000_000
#: Bytes of repeated super-k-mers that a task remembers; more are sent again by later slices, with the same result.
SEEN_BYTES = 8 << 20
#: No minimiser brings more words to its bucket.
HOT_WORDS = 250_000


def _super_kmers(w: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last window of each super-k-mer, and its minimiser."""
    none = np.zeros(0, np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        return none, none, none.astype(U64)
    least, width, wide = gram_hash(hashes, gram), 1, window - gram + 1
    while width < wide:
        step = min(width, wide - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    inside = w.row[:n] == w.row[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none.astype(U64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (w.row[at[1:]] != w.row[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1], least[at[first]]


def _runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where a new range begins, among ranges sorted by document that touch or not."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    return np.flatnonzero(new)


class Pieces(NamedTuple):
    """The super-k-mers of a slice, those of hot minimisers cut into windows."""

    first: np.ndarray
    last: np.ndarray
    least: np.ndarray
    key: np.ndarray  # equal for equal windows
    doc: np.ndarray
    place: np.ndarray
    sent: np.ndarray
    again: np.ndarray  # the same stands earlier in this slice
    leader: np.ndarray  # the first of the same words here
    whole: np.ndarray  # hash of all words


def _pieces(doc_id: np.ndarray, t: Texts, w: Words, window: int, gram: int, hot: np.ndarray) -> Pieces | None:
    """hot: minimisers, sorted."""
    number, hashes = word_numbers(t.data, w.start, w.end)
    first, last, least = _super_kmers(w, hashes, window, gram)
    if not len(first):
        return None
    single = np.zeros(len(first), bool)
    if len(hot):
        single = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        many = np.where(single, last - first + 1, 1)
        first, last, least, single = ragged(first, many), np.repeat(last, many), np.repeat(least, many), np.repeat(single, many)
        last = np.where(single, first, last)
    doc = doc_id[w.row[first]]
    place = first - w.first[w.row[first]]
    one = span_hash(hashes, first, last + window, U64(0xC2B2AE3D27D4EB4F | 1))
    order = np.lexsort((place, doc, one))
    head = np.ones(len(order), bool)
    head[1:] = one[order][1:] != one[order][:-1]
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    sent = leader == np.arange(len(order))
    rest, many = np.flatnonzero(~sent), last - first + window
    alike = many[rest] == many[leader[rest]]
    alike[alike] = same_bytes(number, first[rest[alike]], first[leader[rest[alike]]], many[rest[alike]])
    sent[rest[~alike]] = True  # other words under the same hash
    again = ~sent & ((doc != doc[leader]) | (place != place[leader]))
    return Pieces(first, last, least, np.where(single, one, least), doc, place, sent, again, leader, one)


class Seen:
    """Super-k-mers that repeat, with the earliest document and place at which this task has sent each."""

    def __init__(self, most: int = SEEN_BYTES):
        self.first: dict[int, tuple[tuple[int, int], bytes]] = {}
        self.keys, self.room = np.zeros(0, U64), most

    def settle(self, found: Pieces, t: Texts, w: Words, window: int) -> None:
        """Take back from `sent` what was sent for an earlier document, and remember what repeats here."""
        first, last, _, _, doc, place, sent, again, leader, whole = found

        def said(i: int) -> bytes:
            at = slice(int(first[i]), int(last[i]) + window)
            return joined(t.data, w.start[at], w.end[at])[0].tobytes()

        moved: dict[int, bool] = {}
        for i in np.flatnonzero(sent & np.isin(whole, self.keys)).tolist():
            before, text = self.first[int(whole[i])]
            here = (int(doc[i]), int(place[i]))
            if said(i) != text:
                continue
            if here < before:
                self.first[int(whole[i])] = here, text
            else:
                sent[i], again[i], moved[i] = False, here != before, True
        new = [i for i in np.unique(leader[~sent]).tolist() if i not in moved and sent[i] and int(whole[i]) not in self.first]
        for i in new:
            if self.room <= 0:
                break
            self.first[int(whole[i])] = (int(doc[i]), int(place[i])), said(i)
            self.room -= len(self.first[int(whole[i])][1])
        if new:
            self.keys = np.fromiter(self.first, U64, len(self.first))


def _send(doc_id: np.ndarray, t: Texts, window: int, gram: int, buckets: int, hot: np.ndarray, seen: Seen | None = None) -> list[tuple[int, bytes]]:
    """What goes to each bucket, and under a number below zero the repeats found here."""
    w = words(t)
    found = _pieces(doc_id, t, w, window, gram, hot)
    if found is None:
        return []
    if seen is not None:
        seen.settle(found, t, w, window)
    first, last, _, key, doc, place, sent, again, _, _ = found
    bucket = (key % U64(buckets)).astype(np.int64)
    squeeze, out = zstandard.ZstdCompressor(level=3), []
    r = np.flatnonzero(again)
    if len(r):
        begin = _runs(doc[r], place[r], place[r] + last[r] - first[r])
        known = np.stack([doc[r[begin]], place[r[begin]], (place[r] + last[r] - first[r])[np.append(begin[1:], len(r)) - 1]])
        own = -1 - int(mix(doc[r[:1]].astype(np.int64).view(U64) ^ U64(len(key)))[0] % U64(buckets))
        out.append((own, squeeze.compress(np.concatenate([[0, known.shape[1]], known.ravel()]).astype(np.int64).tobytes())))
    s = np.flatnonzero(sent)
    s = s[np.argsort(bucket[s], kind="stable")]
    count = last[s] - first[s] + window
    at_word = ragged(first[s], count)
    packed, to = joined(t.data, w.start[at_word], w.end[at_word])
    cut = np.append(to, len(packed))[np.append(0, np.cumsum(count))]
    edges = np.append(np.flatnonzero(np.diff(bucket[s], prepend=-1)), len(s))
    for a, b in zip(edges[:-1], edges[1:]):
        head = np.concatenate([[b - a, 0], doc[s[a:b]], place[s[a:b]], count[a:b]]).astype(np.int64)
        out.append((int(bucket[s[a]]), squeeze.compress(head.tobytes() + packed[cut[a] : cut[b]].tobytes())))
    return out


def _hot(rows: DataFrame, window: int, gram: int) -> np.ndarray:
    """All minimisers with more than HOT_WORDS words to send, and some with more than half of that; sorted.

    A task names those of which it has more than its share of HOT_WORDS / 2, so what tasks do not name
    never comes to more than that half.
    """
    share = HOT_WORDS / 2 / max(1, rows.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substrings")
        least, n, waiting = np.zeros(0, U64), np.zeros(0, np.int64), []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([least, *(x for x, _ in waiting)]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n, *(x for _, x in waiting)]), len(keys)).astype(np.int64)

        for b in slices(batches, "text"):
            t = texts(b.column("text"))
            found = _pieces(b.column("doc_id").to_numpy(), t, words(t), window, gram, np.zeros(0, U64))
            if found is not None:
                waiting.append((found.least[found.sent], (found.last - found.first + window)[found.sent]))
            if sum(len(x) for x, _ in waiting) > max(1_000_000, len(least)):
                least, n = summed()
                waiting.clear()
        least, n = summed()
        much = n > share
        yield pa.RecordBatch.from_arrays([pa.array(least[much].view(np.int64)), pa.array(n[much])], ["least", "n"])

    found = rows.mapInArrow(count, "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_WORDS / 2)
    return np.sort(np.array([r.least for r in found.collect()], np.int64).view(U64))


def _repeats(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last): the windows of one bucket whose words also start earlier."""
    doc, place, count, known, data, open_ = [], [], [], [np.zeros((3, 0), np.int64)], [], zstandard.ZstdDecompressor()
    for x in blobs:
        x = open_.decompress(x)
        n, m = np.frombuffer(x, np.int64, 2)
        head = np.frombuffer(x, np.int64, 3 * (n + m), 16)
        doc.append(head[:n]), place.append(head[n : 2 * n]), count.append(head[2 * n : 3 * n])
        known.append(head[3 * n :].reshape(3, m))
        data.append(np.frombuffer(x, np.uint8, offset=int(16 + 24 * (n + m))))
    doc, place, count, data = map(np.concatenate, (doc, place, count, data))
    known = np.concatenate(known, axis=1)
    w = words(Texts(data, np.array([0, len(data)])))
    number, hashes = word_numbers(data, w.start, w.end)
    begin = np.cumsum(count) - count
    windows = count - window + 1
    at = ragged(begin, windows)  # each window's first word
    if not len(at):
        return known[0], known[1], known[2]
    doc_of, start = np.repeat(doc, windows), at - np.repeat(begin - place, windows)
    one = gram_hash(hashes, window)[at]
    order = np.lexsort((start, doc_of, one))
    head = np.ones(len(order), bool)
    head[1:] = one[order][1:] != one[order][:-1]
    leader = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    differ = (doc_of[order] != doc_of[leader]) | (start[order] != start[leader])
    x, y = order[differ], leader[differ]
    same = np.ones(len(x), bool)
    for k in range(window):
        same &= number[at[x] + k] == number[at[y] + k]
    if not same.all():  # windows of one hash with other words: settle those by the words themselves
        clash = np.unique(one[x[~same]])
        x = np.concatenate([x[~np.isin(one[x], clash)], _by_words(number, at, doc_of, start, order, clash, one, window)])
    x = x[np.lexsort((start[x], doc_of[x]))]
    edge = _runs(doc_of[x], start[x], start[x]) if len(x) else np.zeros(0, np.int64)
    end = np.append(edge[1:], len(x)) - 1 if len(x) else edge
    return (np.concatenate([doc_of[x[edge]], known[0]]), np.concatenate([start[x[edge]], known[1]]), np.concatenate([start[x[end]], known[2]]))


def _by_words(number, at, doc_of, start, order, clash, one, window) -> np.ndarray:
    out = []
    for h in clash:
        first: dict = {}
        for i in order[one[order] == h]:
            key = number[at[i] : at[i] + window].tobytes()
            if first.setdefault(key, (doc_of[i], start[i])) != (doc_of[i], start[i]):
                out.append(i)
    return np.array(out, np.int64)


def repeated_ranges(docs: DataFrame, window: int = 20, gram: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, last): ranges of windows, by their first words, whose words also start earlier.

    Earlier: in a smaller doc_id, or in the same document before. The ranges of a document may overlap.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // 2 // BUCKET_WORDS)  # a word takes some six bytes and is sent three times
    hot = _hot(rows, window, gram)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substrings")
        seen = Seen()
        for b in slices(batches, "text"):
            out = _send(b.column("doc_id").to_numpy(), texts(b.column("text")), window, gram, buckets, hot, seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])

    def settle(table):
        doc, first, last = _repeats(table.column("packed").to_pylist(), window)
        return pa.table({"doc_id": doc, "first": first, "last": last})

    sent = rows.mapInArrow(send, "bucket long, packed binary")
    return sent.groupBy("bucket").applyInArrow(settle, "doc_id long, first long, last long")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with lk_doc, a number for each document: its id, but for further texts of one id."""
    version = F.xxhash64("text")
    several = rows.groupBy("doc_id").agg(F.min(version).alias("lk_least"), F.max(version).alias("lk_most")).where("lk_least != lk_most").select("doc_id", "lk_least")
    several = written(several, "several")
    many = several.count()
    if not many:
        return rows.withColumn("lk_doc", F.col("doc_id"))
    rows = rows.join(F.broadcast(several) if many <= SMALL else several, "doc_id", "left")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", version), 2).bitwiseOR(F.lit(1 << 62))
    return rows.withColumn("lk_doc", F.when(F.col("lk_least") != version, own).otherwise(F.col("doc_id"))).drop("lk_least")


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), digests_only: bool = False) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept, kept_sha256): each document without the words of repeated windows.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; `kept` joins the rest by one space. A null text has no
    words; rows with a null id are left out. Of rows that share an id those with other texts than one of
    them are documents of their own, which come after all others; rows alike in both are one document,
    given as often as they stand. `keep` names further columns to carry along, as they are; one with a name
    of this result comes as `input_<name>`. `digests_only` leaves `text` and `kept` out.
    """
    rest = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]) if keep else F.lit(None).cast("boolean")
    rows = _numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), rest.alias("lk_keep")).where("doc_id is not null"))
    ranges = repeated_ranges(rows, window, gram, "lk_doc")
    ranges = ranges.groupBy(F.col("doc_id").alias("lk_doc")).agg(F.collect_list("first").alias("lk_first"), F.collect_list("last").alias("lk_last"))
    rows = rows.join(ranges, "lk_doc", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substrings")
        for b in slices(batches, "text"):
            t = texts(b.column("text"))
            w = words(t)
            change = np.zeros(len(w.start) + 1, np.int64)
            lists = b.column("lk_first"), b.column("lk_last")
            many = np.diff(lists[0].offsets.to_numpy()) if lists[0].null_count == 0 else np.nan_to_num(np.array([len(x) if x is not None else 0 for x in lists[0].to_pylist()])).astype(np.int64)
            if many.sum():
                row = np.repeat(np.arange(len(t)), many)
                first, last = (x.flatten().to_numpy() for x in lists)
                ok = last + window <= np.diff(w.first)[row]
                np.add.at(change, (w.first[row] + first)[ok], 1)
                np.add.at(change, (w.first[row] + last + window)[ok], -1)
            stay = np.cumsum(change[:-1]) == 0
            at = np.flatnonzero(stay)
            packed, to = joined(t.data, w.start[at], w.end[at])
            edge = np.append(to, len(packed))[np.searchsorted(at, w.first)]
            packed = packed.tobytes()
            kept = [packed[x : max(x, y - 1)] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
            n = np.diff(w.first)
            removed = n - np.diff(np.append(0, np.cumsum(stay))[w.first])
            out = {"doc_id": b.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            if not digests_only:
                out |= {"text": b.column("text"), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
            out["lk_keep"] = b.column("lk_keep")
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    for name in () if digests_only else ("text", "kept"):
        schema = schema.add(name, "string")
    schema = schema.add("lk_keep", rows.schema["lk_keep"].dataType)
    out, own = rows.mapInArrow(cut, schema), [f.name for f in schema][:-1]
    return out.select(*own, *[F.col("lk_keep").getField(f"k{i}").alias(f"input_{c}" if c in own else c) for i, c in enumerate(keep)])


#: The same over all windows, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
o AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT o.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM o ANTI JOIN c ON o.doc_id = c.doc_id AND o.p = c.p GROUP BY o.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
