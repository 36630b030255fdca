"""Links inside groups of any size, as a forest, without dealing all pairs of a large group.

A group that one task can hold is compared there. A larger one is dealt into blocks; each block compares
its own rows, and with a few rows that go to all blocks. Where a group holds many versions of one text,
these few tie its blocks together: nearly all of its rows are then in one component, and links inside
that need no further look. Only rows outside it meet the rows of other blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.components import components
from lekha.llm.shared import written
from lekha.llm.vantage import forest

#: Tables of at most so many rows of some 24 bytes are sent to all executors.
SMALL = 500_000
#: Rows of a large group that go to all of its blocks.
HUBS = 8


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def group_links(rows: DataFrame, most: int, weight: int, pairs: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows (group long, node long, n long, ...) -> (u, v): links that join what `pairs` joins within a group.

    pairs(table, left, right) gives index pairs of a table's rows that link, one of left with one of
    right; enough of them to join all that any would. A block has at most about `most` rows and a sum of
    n of `weight`.
    """
    size = rows.groupBy("group").agg(F.count("*").alias("many"), F.sum("n").alias("n")).where("many > 1")
    size = written(size.select("group", F.ceil(F.greatest(F.col("many") / most, F.col("n") / weight, F.lit(1))).cast("int").alias("blocks")), "groups")
    rest = [c for c in rows.columns if c != "group"]
    rows = rows.join(_sent(size), "group").withColumn("b", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    one, all_blocks = F.lit(0), F.sequence(F.lit(0), F.col("blocks") - 1)

    def met(dealt: DataFrame) -> DataFrame:
        def compare(table):
            node, left = table.column("node").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
            order = np.lexsort((~left, node))  # copies of a row: one is enough
            first = order[np.append(True, node[order][1:] != node[order][:-1])]
            i, j = pairs(table, first[left[first]], first)
            root = forest(len(node), i, j)
            linked = np.flatnonzero(root != np.arange(len(node)))
            return pa.table({"u": node[linked], "v": node[root[linked]]})

        return written(dealt.groupBy("group", "i", "j").applyInArrow(compare, "u long, v long"), "links")

    def side(df: DataFrame, i, j, left: bool) -> DataFrame:
        return df.select("group", i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"), *rest)

    large = size.where("blocks > 1")
    if not large.limit(1).count():
        return met(side(rows, F.col("b"), one, True))
    big = rows.where("blocks > 1")
    hubs = big.groupBy("group").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(100 + s)), F.col("node")))["node"] for s in range(HUBS)])).alias("node"))
    hubs = written(hubs.select("group", F.explode("node").alias("node")), "hubs")
    every = big.join(_sent(hubs), ["group", "node"]).withColumn("b", F.explode(all_blocks))
    found = met(side(rows, F.col("b"), one, True).unionByName(side(every, F.col("b"), one, True)))

    at = big.select("group", "node").join(components(found), "node", "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    at = written(at, "parts")
    main = at.groupBy("group", "root").count().groupBy("group").agg(F.max_by("root", "count").alias("main"))
    apart = written(at.join(_sent(written(main, "main")), "group").where("root != main").select("group", "node"), "apart")
    if not apart.limit(1).count():
        return found
    count = written(apart.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "apart_parts")
    big = big.join(_sent(count), "group").withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    left = big.join(_sent(apart), ["group", "node"]).withColumn("b", F.explode(all_blocks))
    right = big.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return found.unionByName(met(side(left, F.col("i"), F.col("b"), True).unionByName(side(right, F.col("i"), F.col("b"), False))))
