"""Vantage-point trees over 64-bit fingerprints, split on Spark until every leaf is small.

A node with more than `leaf` rows gets a tree of its own from a bounded sample of its rows: each inner
node of it has its own vantage point and ball, chosen where both sides come out small. Two fingerprints
at distance <= r differ by at most r in their distance to any point (the triangle bound), so one that
lies inside but within r of the sphere also visits the outside: linked fingerprints then share the leaf
that takes every outside turn of either. Leaves that are still too large are split again, by points of
their own, so the partition follows dense regions down.

Where no ball parts a node's rows (a dense region no wider than a few bits), the node is split by chunks
instead: of r + 1 chunks of the bits that may still differ in it, fingerprints at distance <= r agree on
one. A chunk fixes its bits, so this ends when fewer values are left than a leaf holds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.shared import written
from lekha.llm.text import U64, mix

#: Fingerprints of a node from which its tree is built; the others only follow it.
SAMPLE = 4096
#: Rows of a leaf, at most.
LEAF = 8192
#: Trees (some kB each) sent to the executors at once; more nodes go in several passes.
TREES = 4096
#: Rows of a group of leaves that one call compares, about.
_BUCKET = 1 << 17
_CANDIDATES, _LEAST = 16, 24


class Tree(NamedTuple):
    """Node k: rows within radius[k] of point[k] go on to inside[k], those beyond radius[k] - r to outside[k]; ~j is leaf j."""

    point: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray


def build(sample: np.ndarray, rows: int, leaf: int, radius: int, seed: int = 7) -> Tree | None:
    """A tree for a node of so many rows; None where no ball parts its sample well."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    each = rows / max(1, len(sample))
    todo: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
    while todo:
        own, above, side = todo.pop()
        best = None
        if len(own) * each > 0.8 * leaf and len(own) >= _LEAST:
            for v in rng.choice(own, min(_CANDIDATES, len(own)), replace=False):
                count = np.cumsum(np.bincount(np.bitwise_count(own ^ v), minlength=65)) / len(own)
                inside, outside = count[radius:64], 1 - count[: 64 - radius]
                cost = inside**1.5 + outside**1.5  # both sides small, and few rows on both
                m = int(cost.argmin())
                if cost[m] <= 0.98 and (best is None or cost[m] < best[0]):
                    best = cost[m], v, m + radius
        if best is None:
            at, leaves = ~leaves, leaves + 1
        else:
            d = np.bitwise_count(own ^ best[1]).astype(int)
            at = len(nodes)
            nodes.append([best[1], best[2], 0, 0])
            todo += [(own[d <= best[2]], at, 2), (own[d > best[2] - radius], at, 3)]
        if above >= 0:
            nodes[above][side] = at
    if not nodes:
        return None
    point, ball, inside, outside = zip(*nodes)
    return Tree(np.array(point, U64), np.array(ball, np.int64), np.array(inside, np.int64), np.array(outside, np.int64))


def route(tree: Tree, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): every leaf that each fingerprint visits."""
    row, node, rows, leaves = np.arange(len(prints)), np.zeros(len(prints), np.int64), [], []
    while len(row):
        d = np.bitwise_count(prints[row] ^ tree.point[node]).astype(np.int64)
        ball = tree.radius[node]
        near, far = d <= ball, d > ball - radius
        row, node = np.concatenate([row[near], row[far]]), np.concatenate([tree.inside[node[near]], tree.outside[node[far]]])
        done = node < 0
        rows.append(row[done]), leaves.append(~node[done])
        row, node = row[~done], node[~done]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *leaves])


def chunks(free: int, many: int) -> list[int]:
    """The bits that are free, dealt into so many masks."""
    bits = [k for k in range(64) if free >> k & 1]
    return [sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(bits, int), many)]


def _split(node: np.ndarray, free: np.ndarray, prints: np.ndarray, trees: dict[int, Tree | None], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in the nodes below theirs, as (node, free bits, fingerprint)."""
    out: tuple[list, list, list] = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, U64)]
    order = np.lexsort((free, node))
    node, free, prints = node[order], free[order], prints[order]
    edge = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (free[1:] != free[:-1]))) if len(node) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(node))):
        own, tree = prints[a:b], trees[int(node[a])]
        if tree is not None:
            row, leaf = route(tree, own, radius)
            out[0].append(mix(node[a] ^ mix(leaf.astype(U64) + U64(1)))), out[1].append(np.full(len(row), free[a], U64)), out[2].append(own[row])
            continue
        for k, mask in enumerate(chunks(int(free[a]), radius + 1)):
            value = own & U64(mask)
            out[0].append(mix(node[a] ^ mix(mix(value) + U64(k + 1)))), out[1].append(np.full(b - a, U64(int(free[a]) & ~mask), U64)), out[2].append(own)
    return tuple(map(np.concatenate, out))


def _splitter(sent, radius: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {n: t and Tree(*t) for n, t in ((n, pickle.loads(t)) for n, t in sent.value.items())}
        for b in batches:
            columns = [b.column(c).to_numpy().view(U64) for c in ("node", "free", "fingerprint")]
            known = np.isin(columns[0], np.fromiter(kept, U64, len(kept)))
            trees = kept if known.all() else kept | {int(n): None for n in np.unique(columns[0][~known])}  # without a sample: by chunks
            below = _split(*columns, trees, radius)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in below], ["node", "free", "fingerprint"])

    return of


def leaves(prints: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """prints (fingerprint long), distinct -> (node, free, fingerprint): any two within `radius` share a node.

    No node has more than `leaf` rows, but where fewer bits are free than tell so many apart.
    """
    spark, done, turn = prints.sparkSession, [], 0
    now = written(prints.select(F.lit(0).cast("long").alias("node"), F.lit(-1).cast("long").alias("free"), "fingerprint"), "entries")
    least_bits = max(radius + 1, leaf.bit_length() - 1)
    while True:
        size = now.groupBy("node", "free").agg(F.count("*").alias("n")).where((F.col("n") > leaf) & (F.bit_count("free") > least_bits))
        size = written(size, "large")
        many = size.count()
        if not many:
            return _all(done, now)
        key, small = ["node", "free"], many <= TREES
        done.append(now.join(F.broadcast(size.select(key)) if small else size.select(key), key, "left_anti").select("node", "free", "fingerprint"))
        share = F.lit(float(1 << 30)) * sample / F.col("n")
        some = now.join(F.broadcast(size) if small else size, key).where(F.pmod(F.xxhash64("fingerprint", "node", F.lit(turn)), F.lit(1 << 30)) < share)

        balls = turn < 24  # chunks alone end surely

        def plant(key, table):
            own = np.sort(table.column("fingerprint").to_numpy().view(U64))
            tree = build(own, table.column("n")[0].as_py(), leaf, radius) if balls else None
            return pa.table({"node": [key[0].as_py()], "tree": pa.array([pickle.dumps(tree and tuple(tree))], pa.binary())})

        trees = written(some.select("node", "free", "fingerprint", "n").groupBy("node", "free").applyInArrow(plant, "node long, tree binary"), "trees")
        passes, parts = -(-many // TREES), []
        for k in range(passes):
            mine = trees.where(F.pmod(F.xxhash64("node"), F.lit(passes)) == k).collect() if passes > 1 else trees.collect()  # TREES or so, whatever the input
            sent = spark.sparkContext.broadcast({r.node & (1 << 64) - 1: r.tree for r in mine})
            rows = now.join(F.broadcast(size.select(key)) if small else size.select(key), key, "left_semi").select("node", "free", "fingerprint")
            if passes > 1:
                rows = rows.where(F.pmod(F.xxhash64("node"), F.lit(passes)) == k)
            parts.append(rows.mapInArrow(_splitter(sent, radius), "node long, free long, fingerprint long"))
        now, turn = written(_all(parts[1:], parts[0]), "entries"), turn + 1


def _all(some: list[DataFrame], last: DataFrame) -> DataFrame:
    for df in some:
        last = last.unionByName(df)
    return last


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def joined_within(x: np.ndarray, radius: int) -> np.ndarray:
    """The least index that each fingerprint reaches by steps of at most that distance; prunes by the distance to one point."""
    d = np.bitwise_count(x ^ x[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    s, d, root = x[order], d[order], np.arange(len(x))
    for at in range(0, len(x), 128):
        own = slice(at, at + 128)
        end = int(np.searchsorted(d, d[own][-1] + radius, "right"))
        hit = np.bitwise_count(s[own, None] ^ s[None, at:end]) <= radius
        hit &= root[own, None] != root[None, at:end]
        i, j = np.nonzero(hit)
        if len(i):
            root = forest(len(x), root[i + at], root[j + at])[root]
    least = np.full(len(x), len(x))
    np.minimum.at(least, root, order)
    out = np.empty(len(x), np.int64)
    out[order] = least[root]
    return out


def links(prints: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """prints (fingerprint), distinct -> (u, v): pairs that join all fingerprints at distance <= radius.

    A spanning forest of each leaf's links, not every pair. `sample` bounds the rows that choose a
    node's vantage points; all are partitioned and compared.
    """
    entries = written(leaves(prints, radius, leaf, sample), "leaves")
    spark = entries.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries.count() // _BUCKET)

    def compare(table):
        node, free, x = (table.column(c).to_numpy().view(U64) for c in ("node", "free", "fingerprint"))
        order = np.lexsort((x, free, node))
        node, free, x = node[order], free[order], x[order]
        edge = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (free[1:] != free[:-1])))
        u, v = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(node)).tolist()):
            if b - a > 1:
                root = joined_within(x[a:b], radius)
                linked = np.flatnonzero(root != np.arange(b - a))
                u.append(x[a:b][linked]), v.append(x[a:b][root[linked]])
        return pa.table({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    dealt = entries.withColumn("deal", F.pmod(F.xxhash64("node", "free"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(compare, "u long, v long")
