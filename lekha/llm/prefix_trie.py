"""Conversations that begin alike as one trie of their turns: who shares which beginning, and what that saves.

Distinct conversations are sorted as sequences of turn digests and dealt into blocks by ranges of that order, so
that no beginning, however common, is a group of its own. A block's trie is a string of balanced parentheses
(lekha.llm.parentheses): findclose delimits subtrees, ranks of `()` pairs count their leaves, and differences
of cumulative arrays their members and savings. Only nodes on a block's first and last path can go on in
other blocks. These two spines, with what their nodes have gathered so far, are the sequences of the next,
much smaller level, where spines that several blocks share merge; and so on until one block holds all.
Numbers that a node learns there go back down to the nodes that hang from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.llm.parentheses import Parentheses, Rank
from lekha.llm.resampling import CRC_TABLE, crc32_sql
from lekha.llm.shared import bounded_batches, written
from lekha.llm.text import ragged

#: Bytes of a turn's digest, the first of its SHA-256.
DIGEST = 16
#: Nodes of a block's paths, about.
BLOCK = 1 << 15
#: A block has so many paths at least, so each level has at most a quarter of the paths of the one below.
LEAST_PATHS = 8
#: Consecutive numbers of conversations whose list is one string.
LISTED = 4096
#: Tables of at most so many short rows are sent to all executors in a join.
SMALL = 500_000

#: What a node of a path carries: words of its last text; conversations that end there or in finished subtrees below it;
#: leaves, savings and children of these; and the smallest conversation.
WORDS, CONVS, LEAVES, SAVED, CHILDREN, LEAST = range(6)
_NONE = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_SCHEMA = "kind string, block long, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up_block long, up_side int, path binary, carried array<long>, ends array<string>, shape binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_FIELDS = [(n, _TYPES[t]) for n, t in (f.strip().split(" ") for f in _SCHEMA.split(","))]


def turn_lists(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as array<struct<turn, digest, words>>.

    Turns go by number, null first; of equal numbers by digest. digest: hex digits of the first bytes of the
    SHA-256 of role and text, null ones empty; words: `[^\\x20\\x09-\\x0D]+` of the text. Rows without a
    conversation's number are left out. Texts are read where they lie, only digests are sent.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    said = F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col))
    digest, n = F.substring(F.sha2(said, 256), 1, 2 * DIGEST), F.regexp_count(text(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), n.alias("words")).alias("t")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def regrafted(lists: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """lists (conv_id, turns) with the first h turns of each conversation taken from its group's first conversation.

    That is number c - c % group, all its turns if it has fewer than h, none if there is no such conversation;
    h is the crc32 of c in decimal digits modulo `heads`. The conversation's own turns after its first h follow.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    first = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = lists.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(first, "base", "left")
    cut = lambda x, start, n: F.when(n > 0, F.slice(x, start, F.greatest(n, F.lit(0)))).otherwise(F.slice(x, F.lit(1), F.lit(0)))
    own, head = F.col("turns"), F.coalesce("head", F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(cut(head, F.lit(1), F.col("h")), cut(own, F.col("h") + 1, F.size(own) - F.col("h"))).alias("turns"))


def _list_digests(parts: DataFrame) -> DataFrame:
    """parts (path, chunk, ids) -> (path, ends): the SHA-256 of each path's lists, joined, without holding them all."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for p, ids in zip(b.column("path").to_pylist(), b.column("ids").to_pylist()):
                if p != path:
                    if state is not None:
                        done.append((path, state.hexdigest()))
                    path, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["path", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], ["path", "ends"])

    return parts.select("path", "chunk", "ids").repartition("path").sortWithinPartitions("path", "chunk").mapInArrow(of, "path binary, ends string")


def sequences(lists: DataFrame, listed: int = LISTED) -> DataFrame:
    """lists (conv_id, turns) -> (path, words, n, least, ends), one row for each different sequence of turns.

    path: the digests one after the other; n: the conversations that are this sequence; least: the smallest;
    ends: the SHA-256 of all their numbers, ascending, joined by commas.
    """
    path = F.unhex(F.array_join("turns.digest", ""))
    parts = lists.select("conv_id", path.alias("path"), F.col("turns.words").alias("words"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = written(parts.groupBy("path", F.floor(F.col("conv_id") / listed).alias("chunk")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"), ids.alias("ids")), "parts")
    rows = parts.groupBy("path").agg(F.first("words").alias("words"), F.sum("n").alias("n"), F.min("least").alias("least"), F.count("*").alias("chunks"), F.first(F.sha2("ids", 256)).alias("ends"))
    rows = written(rows, "sequences")
    several = rows.where("chunks > 1").select("path")
    if several.limit(1).count():
        long = written(_list_digests(parts.join(several, "path")), "digests").withColumnRenamed("ends", "joint")
        rows = rows.join(long, "path", "left").withColumn("ends", F.coalesce("joint", "ends"))
    return rows.select("path", "words", "n", "least", "ends")


class Paths(NamedTuple):
    """Sorted different paths, position by position from the root on."""

    block: np.ndarray  # where each path comes from
    side: np.ndarray
    depth: np.ndarray
    digests: np.ndarray  # of all positions but the roots
    carried: np.ndarray  # for each position the six numbers
    ends: np.ndarray


def _read(batch: pa.RecordBatch, level: int) -> Paths:
    path = batch.column("path")
    depth = pa.compute.binary_length(path).to_numpy() // DIGEST
    depth = depth.astype(np.int64)
    digests = np.frombuffer(b"".join(path.to_pylist()), np.uint64).reshape(-1, DIGEST // 8)
    if level:
        carried = batch.column("carried").flatten().to_numpy().reshape(-1, 6)
        ends = np.array(batch.column("ends").flatten().to_pylist(), object)
        return Paths(batch.column("block").to_numpy(), batch.column("side").to_numpy(), depth, digests, carried, ends)
    carried, last = np.zeros((int((depth + 1).sum()), 6), np.int64), np.cumsum(depth + 1) - 1
    carried[ragged(last - depth + 1, depth), WORDS] = batch.column("words").flatten().to_numpy()
    carried[:, LEAST] = _NONE
    carried[last, CONVS], carried[last, LEAST] = batch.column("n").to_numpy(), batch.column("least").to_numpy()
    ends = np.full(len(carried), None, object)
    ends[last] = batch.column("ends").to_pylist()
    return Paths(np.zeros(len(depth), np.int64), np.zeros(len(depth), np.int32), depth, digests, carried, ends)


def _rows(kind: str, n: int, **columns) -> pa.RecordBatch:
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, dict(_FIELDS)[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, t) if f == "kind" else given[f].cast(t) if f in given else pa.nulls(n, t) for f, t in _FIELDS], [f for f, _ in _FIELDS])


def _block(p: Paths, block: int, level: int, top: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one block: finished nodes, the spines, and what became of the spines of the level below."""
    count = p.depth + 1
    first, of_digest = np.cumsum(count) - count, np.cumsum(p.depth) - p.depth
    # how much of its path each has in common with the one before
    common = np.minimum(p.depth[1:], p.depth[:-1])
    a, b = (p.digests[ragged(x, common)] for x in (of_digest[:-1], of_digest[1:]))
    differ = np.flatnonzero((a != b).any(1))
    begin = np.cumsum(common) - common
    which = np.searchsorted(begin + common, differ, "right")
    shared = common.copy()
    np.minimum.at(shared, which, differ - begin[which])
    shared = np.append(-1, shared)

    depth = np.arange(len(p.carried)) - np.repeat(first, count)
    new = depth > np.repeat(shared, count)
    n = int(new.sum())
    # a position that is not new is the last node of its depth before it
    order = np.argsort(depth, kind="stable")
    node = np.empty(len(depth), np.int64)
    node[order] = np.maximum.accumulate(np.where(new, np.cumsum(new), 0)[order] + depth[order] * (n + 1)) - depth[order] * (n + 1) - 1
    parent = np.full(n, -1)
    own = np.flatnonzero(new)
    inner = own[depth[own] > 0]
    parent[node[inner]] = node[inner - 1]

    summed = np.zeros((n, 6), np.int64)
    for k in (CONVS, LEAVES, SAVED, CHILDREN):
        np.add.at(summed[:, k], node, p.carried[:, k])
    summed[:, WORDS], least = p.carried[own, WORDS], np.full(n, _NONE)
    np.minimum.at(least, node, p.carried[:, LEAST])
    ends = np.full(n, None, object)
    has = np.flatnonzero(p.ends != None)  # noqa: E711
    ends[node[has]] = p.ends[has]

    tree = Parentheses(depth[own])
    close = tree.find_close(np.arange(n))
    after = np.arange(n) + (close - tree.open + 1) // 2

    def below(x: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(x))
        return total[after] - total[:n]

    side = np.full(n, -1)
    ends_of = [0] if len(count) == 1 else [len(count) - 1, 0]
    if not top:
        for r in ends_of:
            side[node[first[r] : first[r] + count[r]]] = min(r, 1)
    open_ = side >= 0
    inside = np.bincount(parent[parent >= 0], minlength=n)
    convs, children = below(summed[:, CONVS]), summed[:, CHILDREN] + inside
    leaf = np.zeros(2 * n, bool)
    leaf[tree.open[(children == 0) & ~open_]] = True  # of the () pairs those that nothing hangs from on lower levels
    rank = Rank(leaf & tree.bits & ~np.append(tree.bits[1:], False))
    leaves = rank(close) - rank(tree.open) + below(summed[:, LEAVES])
    saved = below(summed[:, SAVED] + np.where(open_, 0, (convs - 1) * summed[:, WORDS]))
    by_depth = np.argsort(depth[own], kind="stable")
    edge = np.searchsorted(depth[own][by_depth], np.arange(1, int(depth.max()) + 2))
    for k in range(len(edge) - 2, -1, -1):
        nodes = by_depth[edge[k] : edge[k + 1]]
        np.minimum.at(least, parent[nodes], least[nodes])

    done = np.flatnonzero(~open_)
    up = parent[done]
    waits = (up >= 0) & (side[up] >= 0)
    yield _rows(
        "node", len(done), block=np.full(len(done), block), side=pa.array(side[up], pa.int32(), mask=~waits), depth=depth[own][done], conv_id=least[done], parent_conv_id=pa.array(least[up], pa.int64(), mask=(up < 0) | waits),
        n_convs=convs[done], n_children=children[done], n_leaves=leaves[done], saved_tokens=saved[done], ends_sha256=[x or _NO_ENDS for x in ends[done]],
    )
    yield _rows("shape", 1, block=[block], shape=[np.packbits(tree.bits, bitorder="little").tobytes()])
    if level:
        row = np.repeat(np.arange(len(count)), count)
        waits = open_[node]
        yield _rows("link", len(node), block=p.block[row], side=p.side[row], depth=depth, conv_id=pa.array(least[node], pa.int64(), mask=waits), up_block=pa.array(np.full(len(node), block), pa.int64(), mask=~waits), up_side=pa.array(side[node], pa.int32(), mask=~waits))
    if top:
        return
    out = np.stack([summed[:, WORDS], convs, leaves, saved, children, least], 1)
    spine = np.flatnonzero(open_ & (parent >= 0))
    for k, x in ((CONVS, convs), (LEAVES, leaves), (SAVED, saved), (CHILDREN, np.ones(n, np.int64))):
        np.subtract.at(out[:, k], parent[spine], x[spine])
    for r in reversed(ends_of):
        nodes = node[first[r] : first[r] + count[r]]
        carried = out[nodes]
        carried[side[nodes] != min(r, 1), CONVS : CHILDREN + 1] = 0  # of a node on both spines the first carries it
        path = p.digests[of_digest[r] : of_digest[r] + p.depth[r]].tobytes()
        yield _rows("path", 1, block=[block], side=[min(r, 1)], path=[path], carried=[carried.ravel()], ends=[list(ends[nodes])])


def _level(rows: DataFrame, level: int, top: bool, most: int) -> DataFrame:
    """One level: sorted partitions of paths as blocks of about `most` nodes, or all as one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, waiting, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, LEAST_PATHS)
                at += LEAST_PATHS
                waiting.append(piece)
                n += sum(map(len, piece.column("path").to_pylist())) // DIGEST + piece.num_rows
                if n >= most and not top and sum(x.num_rows for x in waiting) >= LEAST_PATHS:
                    yield from _block(_joined([_read(x, level) for x in waiting]), part << 32 | k, level, top)
                    waiting, n, k = [], 0, k + 1
        if waiting:
            yield from _block(_joined([_read(x, level) for x in waiting]), part << 32 | k, level, top)

    return written(rows.mapInArrow(of, _SCHEMA), f"level{level}")


def _joined(parts: list[Paths]) -> Paths:
    return Paths(*map(np.concatenate, zip(*parts)))


def _learned(rows: DataFrame, known: DataFrame, block: Column, side: Column, depth: Column) -> DataFrame:
    """rows with conv_id of the node at that place of a spine, as `learned`."""
    known = known.select(F.col("block").alias("k_block"), F.col("side").alias("k_side"), F.col("depth").alias("k_depth"), F.col("conv_id").alias("learned"))
    return rows.join(F.broadcast(known) if known.count() <= SMALL else known, (block == F.col("k_block")) & (side == F.col("k_side")) & (depth == F.col("k_depth")))


def prefix_trie(lists: DataFrame, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    lists (conv_id, turns), as turn_lists gives them, one row a conversation. Each different sequence of first d
    turns is a node, the root with d = 0 is the parent of all. n_convs conversations begin with it, conv_id is
    the smallest; saved_tokens sums (n_convs - 1) times the words of the last turn over the node and all below it;
    ends_sha256 digests the conversations that end there. A conversation without turns ends at the root; no
    conversations give no rows. A conversation's digests (16 bytes a turn) must fit in a row.
    """
    spark = lists.sparkSession
    bounded_batches(spark)
    rows, level, tables = written(sequences(lists, listed), "paths"), 0, []
    while True:
        n, nodes = rows.agg(F.count("*"), F.sum(F.octet_length("path") / DIGEST + 1)).first()
        if not n:
            break
        top = nodes <= block or n <= LEAST_PATHS
        blocks = int(max(1, min(nodes // block, n // LEAST_PATHS)))
        dealt = rows.coalesce(1) if top else rows.repartitionByRange(blocks, "path")
        tables.append(_level(dealt.sortWithinPartitions("path"), level, top, block))
        if top:
            break
        rows, level = tables[-1].where("kind = 'path'").select("block", "side", "path", "carried", "ends"), level + 1
    out, known = None, None
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for t in reversed(tables):
        nodes, links = t.where("kind = 'node'"), t.where("kind = 'link'").select("block", "side", "depth", "conv_id", "up_block", "up_side")
        ready = nodes.where("side is null").select(result)
        if known is not None:
            late = _learned(nodes.where("side is not null"), known, F.col("block"), F.col("side"), F.col("depth") - 1)
            ready = ready.unionByName(late.withColumn("parent_conv_id", F.col("learned")).select(result))
            late = _learned(links.where("conv_id is null"), known, F.col("up_block"), F.col("up_side"), F.col("depth"))
            links = links.where("conv_id is not null").unionByName(late.withColumn("conv_id", F.col("learned")).select(links.columns))
        out = ready if out is None else out.unionByName(ready)
        known = written(links.select("block", "side", "depth", "conv_id"), "links") if t is not tables[0] else None
    if out is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return out


#: The query from every prefix of every conversation, for DuckDB.
SQL = rf"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text)[1:32] AS g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
l AS (SELECT conv_id, list({{'g': g, 'w': w}} ORDER BY turn NULLS FIRST, g) AS x FROM t GROUP BY conv_id),
h AS (SELECT conv_id, x, CAST({crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS BIGINT) AS h FROM l, crc_table),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.x, []), 1, h), list_slice(h.x, h + 1, len(h.x))) AS x FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, array_to_string([e.g FOR e IN list_slice(x, 1, d)], '') AS k, CASE WHEN d > 0 THEN x[d].w ELSE 0 END AS w, len(x) = d AS last FROM (SELECT *, unnest(range(0, len(x) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY k, d),
c AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT left(k, 32 * a) AS k, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT n.*, n_children, unnest(range(0, d + 1)) AS a FROM n LEFT JOIN c USING (k)) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n q ON n.d > 0 AND q.k = left(n.k, 32 * (n.d - 1)) LEFT JOIN c ON c.k = n.k JOIN s ON s.k = n.k
"""
