"""SimHash near-duplicates: equal fingerprints are one node, and vantage-point trees (lekha.llm.vantage) find those close by.

Balls tell fingerprints apart up to a few bits; texts with four fifths of their five-word shingles in
common differ in some ten bits of 64, where every ball would have to be visited. `similar_documents`
therefore has a second source of candidates, another sketch of the same shingles: the least of each of
many hash functions, where five in a row make a key. Both only propose: documents that candidates
join are compared by their sets of shingles, and these alone decide. Large groups of candidates are first
narrowed by the rare shingles of each set (`narrowed`), so that documents of one form do not meet all others.

Equal fingerprints and equal sets are one node, so groups of copies never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.components import components
from lekha.llm.meeting import group_links
from lekha.llm.shared import bounded_batches, written
from lekha.llm.text import LOWER, U64, Texts, gram_hash, joined, mix, ragged, slices, span_hash, texts, word_hash, words, worker_cache
from lekha.llm.vantage import forest, links

#: Tables of at most so many rows of 24 bytes are sent to all executors.
SMALL = 500_000


def _fold(t: Texts, shingle: int) -> np.ndarray:
    """Each row's 64-bit fingerprint."""
    low = LOWER[t.data]
    w = words(Texts(low, t.begin))
    out = np.zeros(len(t), np.uint64)
    if not len(w.start):
        return out
    packed, to = joined(low, w.start, w.end)  # a shingle is one piece of this string
    packed, begin, end = packed.tobytes(), to.tolist(), (to + w.end - w.start).tolist()
    digest = xxhash.xxh64_intdigest
    for r in range(len(t)):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if a == b:
            continue
        last = max(a + 1, b - shingle + 1)
        far = min(shingle, b - a) - 1
        h = np.array([digest(packed[s:e], 42) for s, e in zip(begin[a:last], end[a + far : last + far])], np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[r] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fingerprint long): majority bits of the XXH64 (seed 42) of every word shingle.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; fewer words than a shingle make one.
    Null and wordless texts get fingerprint 0; rows with a null id are left out; repeated ids stay.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_fold(texts(b.column("text")), shingle).view(np.int64))], ["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(of, "doc_id long, fingerprint long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint string, component_id): documents linked by fingerprints at distance <= radius.

    component_id is the least doc_id that links can reach, the document itself included. Null and
    wordless texts have fingerprint zero and link like any other; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "prints")
    out = _by_fingerprint(rows, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _by_fingerprint(rows: DataFrame, radius: int) -> DataFrame:
    """rows (doc_id, fingerprint), a stored table -> with component_id."""
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    found = written(components(links(prints.select("fingerprint"), radius)), "components")
    least = found.join(prints, F.col("node") == F.col("fingerprint")).groupBy("root").agg(F.min("first").alias("least"))
    group = found.join(least, "root").select(F.col("node").alias("fingerprint"), "least")
    group = written(prints.join(group, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id")), "groups")
    return rows.join(group, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: Minima of a sketch, and how many in a row make a key under which documents meet: at a similarity of 0.8
#: no key of 25 agrees for one pair in 20,000.
MINIMA, ROW = 125, 5
_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=U64)) | U64(1)
#: Sets of shingles compared in one block, and shingles in it.
_SETS, _SHINGLES = 500, 1_000_000


class Shingles(NamedTuple):
    values: np.ndarray  # hashes, text by text
    begin: np.ndarray  # where those of each text with words begin
    full: np.ndarray  # the texts with words
    rows: int


def _shingles(t: Texts, shingle: int) -> Shingles:
    low = LOWER[t.data]
    w = words(Texts(low, t.begin))
    h, n = word_hash(low, w.start, w.end), np.diff(w.first)
    full = np.flatnonzero(n)
    if not len(full):
        return Shingles(np.zeros(0, U64), full, full, len(t))
    grams = gram_hash(h, shingle)
    count = np.maximum(1, n - shingle + 1)[full]
    at = np.repeat(w.first[:-1][full] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    values = grams[np.minimum(at, len(grams) - 1)] if len(grams) else np.zeros(len(at), U64)
    few = np.flatnonzero(n[full] < shingle)
    begin = np.cumsum(count) - count
    if len(few):
        values[begin[few]] = span_hash(h, w.first[:-1][full][few], w.first[1:][full][few])
    return Shingles(values, begin, full, len(t))


def _minima(s: Shingles) -> np.ndarray:
    """The least value of each hash function over each row's shingles, upper halves; all ones without words."""
    out = np.full((s.rows, MINIMA), 0xFFFFFFFF, np.uint32)
    if len(s.full):
        for k, f in enumerate(_FACTORS):
            out[s.full, k] = np.minimum.reduceat(s.values * f, s.begin) >> U64(32)
    return out


def _sets(s: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's different shingles, values[first[r]:first[r + 1]], and a 64-bit hash of the set."""
    row = np.repeat(s.full, np.diff(np.append(s.begin, len(s.values))))
    order = np.lexsort((s.values, row))
    row, values = row[order], s.values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[new], values[new]
    first = np.searchsorted(row, np.arange(s.rows + 1))
    total = np.append(U64(0), np.cumsum(mix(values ^ U64(0x9E3779B97F4A7C15)), dtype=U64))[first]
    return values, first, mix((total[1:] - total[:-1]) + np.diff(first).astype(U64) * U64(0xD6E8FEB86659FD93))


def _alike(values: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of sets in left with sets in right of at least that Jaccard similarity, enough to join all that any would."""
    size, root, pairs = np.diff(first), np.arange(len(first) - 1), [np.zeros((0, 2), np.int64)]
    number = np.unique(values, return_inverse=True)[1]
    mine = np.zeros(len(values), np.uint8)
    right = right[np.argsort(size[right], kind="stable")]
    ranked = size[right]
    for i in left[size[left] > 0].tolist():
        near = right[np.searchsorted(ranked, math.ceil(size[i] * similarity - 1e-6)) : np.searchsorted(ranked, math.floor(size[i] / similarity + 1e-6), "right")]
        near = near[root[near] != root[i]]
        if not len(near):
            continue
        mine[number[first[i] : first[i + 1]]] = 1
        count = size[near]
        both = np.add.reduceat(mine[number[ragged(first[near], count)]], np.cumsum(count) - count, dtype=np.int64)
        mine[number[first[i] : first[i + 1]]] = 0
        hit = near[both / (size[i] + count - both) >= similarity]
        if len(hit):
            pairs.append(np.stack([np.full(len(hit), i), hit], 1))
            roots = np.unique(np.append(root[hit], root[i]))
            root[np.isin(root, roots)] = roots[0]
    return tuple(np.concatenate(pairs).T)


def key_links(keys: DataFrame) -> DataFrame:
    """keys (id, keys array<long>) -> (u, v): links that join all ids with a key in common, one for each id and key at most."""
    keyed = keys.select("id", F.explode("keys").alias("key"))
    met = written(keyed.groupBy("key").agg(F.count("*").alias("many"), F.min("id").alias("least")).where("many > 1").select("key", "least"), "keys")
    return keyed.join(F.broadcast(met) if met.count() <= SMALL else met, "key").where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v"))


#: Cells in which shingles of large groups are counted: what the driver and each executor hold of them.
_CELLS = 1 << 21
#: Joined documents of one group are compared with each other up to so many; more are narrowed first.
_NARROW = 500


def _set_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """How many sets of rows (text) hold a shingle of each cell."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CELLS, np.int64)
        for b in slices(batches, "text"):
            total += np.bincount((_sets(_shingles(texts(b.column("text")), shingle))[0] % U64(_CELLS)).astype(np.int64), minlength=_CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "many"])

    counted = rows.select("text").mapInArrow(of, "cell int, many long").groupBy("cell").agg(F.sum("many").alias("many")).toArrow()
    out = np.zeros(_CELLS, np.int32)
    out[counted.column("cell").to_numpy()] = np.minimum(counted.column("many").to_numpy(), np.iinfo(np.int32).max)
    return out


def narrowed(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """rows (node, root, text), different sets, read twice -> (node, root): smaller groups within the roots, none parting sets that link.

    Put in one order, two similar sets of shingles have one in common among the first of each: with t the
    similarity, among the first n - ceil(2t / (1 + t) n) + 1 of the smaller set and n - ceil(tn) + 1 of the
    larger one. Any order is right; with the rare ones first, shingles that very many share, such as a
    form's, are among the first of the smaller set only where little else is in it. So sets are joined by what
    comes early in both, each as the smaller with one that may be larger. Sets that meet none are left out.

    In a task, shingles that an early set of the same slice has are settled there and go on once; rarity
    is counted in _CELLS cells, and shingles alone in their cell do not travel.
    """
    counts = rows.sparkSession.sparkContext.broadcast(_set_counts(rows, shingle))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = counts.value
        for b in slices(batches, "text"):
            values, first, _ = _sets(_shingles(texts(b.column("text")), shingle))
            size, node = np.diff(first), b.column("node").to_numpy()
            row, common = np.repeat(np.arange(len(size)), size), many[(values % U64(_CELLS)).astype(np.int64)]
            order = np.lexsort((values, common, row))
            place = np.arange(len(values)) - first[row]
            early = place < (size - np.ceil(size * similarity - 1e-6) + 1)[row]
            short = place < (size - np.ceil(size * (2 * similarity / (1 + similarity)) - 1e-6) + 1)[row]
            take = early & (common[order] > 1)
            row, short, key = row[take], short[take], values[order][take]
            key = mix(key ^ mix(b.column("root").to_numpy().view(U64))[row])  # two keys that collide join too much, never too little
            here = node[row]
            least = np.lexsort((here, ~short, key))  # an early set comes first of each key
            key, here, short = key[least], here[least], short[least]
            start = np.append(True, key[1:] != key[:-1])[: len(key)]
            head = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
            settled = short[head]  # the key has an early set in this slice
            go = start | ~settled
            inside = settled & (here != here[head])
            names, at = np.unique(np.concatenate([here[inside], here[head][inside]]), return_inverse=True)
            i, j = at.reshape(2, -1)
            root = forest(len(names), i, j)
            moved = np.flatnonzero(root != np.arange(len(names)))
            columns = [np.append(key[go].view(np.int64), np.zeros(len(moved), np.int64)), np.append(here[go], names[moved]), np.append(short[go], np.zeros(len(moved), bool))]
            other = pa.array(np.append(np.zeros(go.sum(), np.int64), names[root[moved]]), mask=np.append(np.ones(go.sum(), bool), np.zeros(len(moved), bool)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), other], ["key", "node", "short", "other"])

    found = written(rows.select("node", "root", "text").mapInArrow(of, "key long, node long, short boolean, other long"), "early")
    keyed = found.where("other is null")
    met = keyed.groupBy("key").agg(F.min(F.when(F.col("short"), F.col("node"))).alias("least"), F.count("*").alias("many"))
    met = written(met.where("least is not null and many > 1").select("key", "least"), "early_keys")
    across = keyed.join(F.broadcast(met) if met.count() <= SMALL else met, "key").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return components(across.unionByName(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))))


def set_links(sets: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """sets (node, root, n, text): texts by the hashes and sizes of their sets -> (u, v): links that join nodes of one root.

    All that a root's sets link is joined, and sets are compared exactly; large groups are narrowed before.
    A text whose set has another hash than its node is passed over.
    """

    def pairs(table, left, right):
        values, first, own = _sets(_shingles(texts(table.column("text")), shingle))
        good = own.view(np.int64) == table.column("node").to_numpy()
        return _alike(values, first, left[good[left]], right[good[right]], similarity)

    sets = written(sets.select("root", "node", "n", "text"), "sets")
    large = written(sets.groupBy("root").count().where(F.col("count") > _NARROW).select("root"), "large")
    if large.limit(1).count():
        large = F.broadcast(large) if large.count() <= SMALL else large
        big = sets.join(large, "root", "left_semi")
        group = written(narrowed(big, similarity, shingle), "narrowed")
        big = big.drop("root").join(F.broadcast(group) if group.count() <= SMALL else group, "node").select(*sets.columns)
        sets = written(sets.join(large, "root", "left_anti").unionByName(big), "narrowed_sets")
    return group_links(sets.select(F.col("root").alias("group"), "node", "n", "text"), _SETS, _SHINGLES, pairs)


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, group, component_id): documents linked by `similarity` of their shingles.

    component_id is the least doc_id that links can reach, `group` is a number that only linked documents
    share, and version the XXH64 of the text: rows of one id with other texts are documents of their own.

    Similarity is the share of all their different shingles (by 64-bit hashes) that two documents
    have in common. Candidates are pairs with fingerprints at distance <= radius and pairs that share
    five least shingles in a row; all documents that candidates join are compared exactly, and only pairs
    at the bound or above link. Rules for ids, nulls and wordless texts as for near_duplicates; these texts are alike.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for b in slices(batches, "text"):
            t = texts(b.column("text"))
            s = _shingles(t, shingle)
            _, first, node = _sets(s)
            rows = _minima(s).reshape(len(t), -1, ROW).astype(U64)
            keys = np.zeros(rows.shape[:2], U64) + np.arange(rows.shape[1], dtype=U64)
            for k in range(ROW):
                keys = mix(keys * U64(0x9E3779B97F4A7C15) + rows[:, :, k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
            columns = [b.column("doc_id"), b.column("version"), pa.array(node.view(np.int64)), pa.array(np.diff(first)), pa.array(_fold(t, shingle).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "node", "n", "fingerprint", "keys"])

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = written(docs.mapInArrow(of, "doc_id long, version long, node long, n long, fingerprint long, keys array<long>"), "sketches")
    different = rows.groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.max("n").alias("n"), F.min("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"))
    different = written(different.withColumn("id", F.col("least.doc_id")).withColumn("version", F.col("least.version")).drop("least"), "different")
    near = _by_fingerprint(different.select(F.col("node").alias("doc_id"), "fingerprint"), radius).select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    close = key_links(different.select(F.col("node").alias("id"), "keys"))
    candidates = components(near.where("u != v").unionByName(close))
    sets = written(candidates.join(different.select("node", "id", "version", "n"), "node"), "candidates")
    sets = sets.join(docs.withColumnRenamed("doc_id", "id"), ["id", "version"]).dropDuplicates(["id", "version"]).select("node", "root", "n", "text")
    found = components(set_links(sets, similarity, shingle)).join(different.select("node", "id"), "node")
    least = found.groupBy("root").agg(F.min("id").alias("least"))
    found = written(found.join(least, "root").select("node", "least", "root"), "joined")
    group = written(different.select("node", "id").join(F.broadcast(found) if found.count() <= SMALL else found, "node", "left").select("node", F.coalesce("root", "node").alias("group"), F.coalesce("least", "id").alias("component_id")), "groups")
    return rows.select("doc_id", "version", "node").join(group, "node").select("doc_id", "version", "group", "component_id")
