"""Exact top-k inner products of integer vectors, by descending norm.

Candidates lie in blocks by descending length. Rotating all vectors onto the right singular vectors
of the candidates gathers most of a product in its first terms; what the other terms can add is at
most the product of the two remainders' lengths (Cauchy-Schwarz). A candidate whose bound is below
the k-th score found so far is left without its exact product, and so is the rest of a block once
the full lengths' product is below. Each query starts with the k-th score among the longest candidates.
From that, each block of queries has a least length that a candidate must have, and only the vectors of
candidate blocks that reach it are brought together with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lekha.llm.shared import written

#: Longest candidates that give every query its first bound; more only tightens it.
HEAD = 2048
#: Vectors of a block, and its bytes, at most.
QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_BYTES, _STEP = 2048, 16384, 8 << 20, 1024
#: Query blocks of at most so many bytes in all are sent to all executors.
SMALL_BYTES = 32 << 20
#: Lengths are put in steps of an eighth of a doubling, this many below the longest.
_LEVELS = 200
_LONG = 1 << 63


def integer_vectors(table: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, norm): floor(scale * x) of each component as double.

    Rows whose id or vector is null, or whose vector holds null or non-finite components, are left out.
    """
    x = F.col("x")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    odd = F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == F.lit(math.inf)))
    v = F.transform(x, lambda a: F.floor(a * scale).cast("double"))
    rows = rows.where(~odd).select("vec_id", v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    for i, x in enumerate(column):
        out[i, : len(x)] = x.as_py()
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all candidates as columns, strongest first, from their summed outer products."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column("v"), dim)
            total += x.T @ x
        part = np.full(dim, TaskContext.get().partitionId() % some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(part), pa.array([r.tobytes() for r in total], pa.binary())], ["at", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        """A row of the matrix, summed in the order of bytes, so that it is the same each time."""
        total = np.sum([np.frombuffer(x, float) for x in sorted(table.column("sums").to_pylist())], axis=0)
        return pa.table({"at": table.column("at")[:1], "part": pa.array([0]), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "at long, part long, sums binary"
    some = math.isqrt(max(1, vectors.rdd.getNumPartitions()))  # two levels: no group has more rows than about the root of all tasks
    rows = vectors.select("v").mapInArrow(of, schema).groupBy("at", "part").applyInArrow(add, schema).groupBy("at").applyInArrow(add, schema).collect()  # `dim` rows of 8 * dim bytes
    total = np.zeros((dim, dim))
    for r in rows:
        total[r.at] = np.frombuffer(r.sums, float)
    scale = np.abs(total).max() or 1.0
    return np.linalg.eigh(total / scale)[1][:, ::-1].copy()


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows with all rows."""
    if a.shape[1] * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) < 2**53:
        return (a @ b.T).astype(np.int64)
    wide = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(wide, -_LONG, _LONG - 1).astype(np.int64)


class Block:
    """Vectors with their rotated parts and lengths; rows tells rows apart that share an id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, turn: np.ndarray, lead: int):
        self.ids, self.rows, self.x = ids, rows, x
        turned = x @ turn
        self.lead = turned[:, :lead].copy()
        self.norm = np.sqrt((x * x).sum(1))
        self.rest = np.sqrt((turned[:, lead:] ** 2).sum(1))


def search(q: Block, c: Block, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score), the k best of the block for each query that reach `floor`, best first, ties to smaller ids; candidates by descending norm."""
    query, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    floor = floor.astype(float)
    for at in range(0, len(c.ids), _STEP):
        part = slice(at, at + _STEP)
        slack = 1e-9 * q.norm * c.norm[at]  # rounding of the rotated sums
        live = np.flatnonzero(q.norm * c.norm[at] + slack >= floor)
        if not len(live):
            break
        bound = q.lead[live] @ c.lead[part].T + q.rest[live, None] * c.rest[None, part] + slack[live, None]
        keep = bound >= floor[live, None]
        cols = np.flatnonzero(keep.any(0))
        live, keep = live[keep.any(1)], keep[keep.any(1)][:, cols]
        if not len(live):
            continue
        exact = _dot(q.x[live], c.x[part][cols])
        keep &= (exact >= floor[live, None]) & (c.rows[part][cols] != q.rows[live, None])
        if len(cols) > k:  # those below a row's own k-th go, ties stay
            kth = -np.partition(np.where(keep, ~exact, _LONG - 1), k - 1, axis=1)[:, k - 1] - 1
            keep &= exact >= kth[:, None]
        i, j = np.nonzero(keep)
        query, ids, scores = np.append(query, live[i]), np.append(ids, c.ids[part][cols][j]), np.append(scores, exact[i, j])
        order = np.lexsort((ids, ~scores, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < k], place[place < k]
        query, ids, scores = query[order], ids[order], scores[order]
        full = place == k - 1
        floor[query[full]] = np.maximum(floor[query[full]], scores[full])
    return query, ids, scores


def meeting(q: DataFrame, c: DataFrame) -> DataFrame:
    """q (q, reach), c (c, reach) -> (q, c): blocks of candidates whose longest reaches what a block of queries asks for.

    Joined by steps of length, of which there is a fixed number, so no list is gathered and no pair is tried.
    """
    longest = c.agg(F.max("reach")).first()[0] or 0.0
    top = math.floor(8 * math.log2(longest)) if longest > 0 else 0
    level = F.when(F.col("reach") > 0, F.greatest(F.lit(top - _LEVELS), F.floor(8 * F.log2("reach")).cast("int"))).otherwise(F.lit(top - _LEVELS))
    levels = F.when(level <= top, F.sequence(level, F.lit(top))).otherwise(F.array().cast("array<int>"))
    asked = q.select("q", F.col("reach").alias("least"), F.explode(levels).alias("level"))
    return asked.join(c.select("c", "reach", level.alias("level")), "level").where("reach >= least").select("q", "c")


def top_inner_products(table: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best among all other rows.

    Score: the integer inner product of floor(scale * x); ties go to the smaller vec_id; fewer than k
    candidates give fewer rows. Vectors that are null or hold null or non-finite components take no
    part; shorter ones end in zeros; scores beyond 64 bits are held at the limit. Rows that share an id
    are rows like others: each of a query's is answered, and the others are candidates of it.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    spark = table.sparkSession
    vectors = written(integer_vectors(table, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dim or dim < 1:
        return spark.createDataFrame([], schema)
    turn, lead = rotation(vectors, dim), max(1, dim // 3)
    fit = max(64, BLOCK_BYTES // (8 * dim))
    head_rows = vectors.orderBy(F.desc("norm"), "vec_id").limit(min(HEAD, fit)).toArrow().combine_chunks()
    seed_from = [head_rows.column(c).to_numpy() for c in ("vec_id", "row")] + [_matrix(head_rows.column("v").combine_chunks(), dim)]

    def pack(size: int, seed: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head = Block(*seed_from, turn, lead) if seed else None
            waiting: list[tuple[np.ndarray, ...]] = []

            def out() -> pa.RecordBatch:
                i, r, x = (np.concatenate(p) for p in zip(*waiting))
                own = Block(i, r, x, turn, lead)
                floor, reach = np.full(len(i), -np.inf), own.norm.max()
                if seed:
                    query, _, s = search(own, head, floor, k)
                    last = np.flatnonzero(np.bincount(query, minlength=len(i)) == k)
                    floor[last] = s[np.searchsorted(query, last, "right") - 1]
                    # no candidate below this length can reach any floor
                    reach = np.where(floor > 0, floor / np.maximum(own.norm * (1 + 1e-9), 1e-300), 0.0).min()
                waiting.clear()
                return pa.RecordBatch.from_arrays([*(pa.array([y.tobytes()], pa.binary()) for y in (i, r, x, floor)), pa.array([float(reach)])], ["ids", "rows", "x", "floor", "reach"])

            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    b = whole.slice(at, size)
                    waiting.append((b.column("vec_id").to_numpy(), b.column("row").to_numpy(), _matrix(b.column("v"), dim)))
                    if sum(len(w[0]) for w in waiting) >= size:
                        yield out()
            if waiting:
                yield out()

        return of

    packed = "ids binary, rows binary, x binary, floor binary, reach double"
    wide = min(CANDIDATE_BLOCK, fit)
    blocks = max(1, math.ceil(n / wide), min(n // 1024, 4 * spark.sparkContext.defaultParallelism))
    order = vectors.repartitionByRange(blocks, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    c = order.select("vec_id", "row", "v").mapInArrow(pack(wide, False), packed).withColumn("c", F.monotonically_increasing_id())
    c = written(c.drop("floor"), "candidates")
    asked, many = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "row", "v"), min(QUERY_BLOCK, fit)
    q = asked.repartition(max(1, math.ceil(n / every / many))).mapInArrow(pack(many, True), packed).withColumn("q", F.monotonically_increasing_id())
    q = written(q.select("q", "reach", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("x").alias("q_x"), "floor"), "queries")

    # lengths alone say which blocks meet: a row of numbers for each pair, and vectors for those only
    reached, asked_rows = meeting(q, c), q.agg(F.sum(F.length("q_ids"))).first()[0] or 0
    q_rows = q.drop("reach")
    grid = reached.join(F.broadcast(q_rows) if asked_rows * (dim + 3) <= SMALL_BYTES else q_rows, "q").join(c.drop("reach"), "c")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, r, x, qa, qr, qx, floor = (np.frombuffer(b.column(name)[i].as_buffer(), kind) for name, kind in (("ids", np.int64), ("rows", np.int64), ("x", float), ("q_ids", np.int64), ("q_rows", np.int64), ("q_x", float), ("floor", float)))
                number, ids, scores = search(Block(qa, qr, qx.reshape(-1, dim), turn, lead), Block(a, r, x.reshape(-1, dim), turn, lead), floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), b.column("q")[i].as_py())), pa.array(number), pa.array(qa[number]), pa.array(ids), pa.array(scores)], ["q", "n", "query_id", "vec_id", "score"])

    met = grid.select("q", "ids", "rows", "x", "q_ids", "q_rows", "q_x", "floor").mapInArrow(meet, "q long, n long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q", "n").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same over all pairs, for DuckDB.
SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
