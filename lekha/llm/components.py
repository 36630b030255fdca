"""Connected components by alternating stars, for edge lists of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.shared import written
from lekha.llm.vantage import forest

#: A table of at most so many (node, least) rows of 16 bytes is sent to all executors in a join.
SMALL = 500_000
#: Edges that a task contracts at once.
_AT_ONCE = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to stars: each node a task meets, with the least it reaches over the edges read there."""
    waiting: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(waiting, axis=1), return_inverse=True)
        i, j = at.reshape(2, -1)
        root = forest(len(nodes), i, j)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    for b in batches:
        waiting.append(np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]))
        if sum(x.shape[1] for x in waiting) >= _AT_ONCE:
            yield out()
    if waiting:
        yield out()


def _star(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """edges (u, v) with u > v, a stored table. Links each node's larger (or smaller) neighbours to the least node next to it."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = near.join(F.broadcast(least) if small else least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where("u > v").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) long -> (node, root): each node that has an edge, with the least node it can reach.

    Every task first contracts the edges it reads; then large stars and small stars alternate until
    nothing changes. The number of rounds grows with the logarithm of the longest chain. Self-loops and
    repeats are allowed, rows with a null are ignored, and no edges give no rows.
    """
    known = edges.where("u is not null and v is not null and u != v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = written(known.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    last = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        small = 2 * state[0] <= SMALL
        last, now = state, _star(_star(now, True, small), False, small)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
