"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into chunks of eight bits, lowest
first; level k keeps the k-th chunks of all ids that have one, a bitmap says which of them continue
on the next level, and a rank directory counts the set bits before every 64 bytes of it. The i-th
id's next chunk is then at rank(i), so any token is read without decoding its neighbours.

    "DAC1", levels u32, documents u64, tokens u64
    document ids i64[documents], first token of each u64[documents + 1]
    for each level: chunks u64 (count), chunks u8[count], bitmap u8[ceil(count / 8)], ranks u32[ceil(count / 512)]

A store is a Parquet table of segments, so it lies wherever Spark can write, and a reader takes only
the segments it needs. Segments and the documents in them ascend by document id.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekha.llm.pretoken import IdCache, pieces
from lekha.llm.shared import bounded_batches
from lekha.llm.text import slices, worker_cache

_BLOCK = 512
#: Tables of at most so many short rows are sent to all executors in a join.
SMALL = 500_000


def pack_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bits).astype(np.uint32), np.arange(0, len(bits), _BLOCK // 8)) if len(bits) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    first = np.append(0, np.cumsum(counts)).astype("<u8")
    return b"DAC1" + struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)) + doc_ids.astype("<i8").tobytes() + first.tobytes() + b"".join(levels)


class Segment:
    """Random access to one segment's tokens."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a token segment")
        levels, docs, self.n_tokens = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.first = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            at += 8 + n + len(bits)
            ranks = np.frombuffer(data, "<u4", -(-n // _BLOCK), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bits, ranks = self.levels[level]
        block = i // _BLOCK
        byte = i // 8
        inside = np.bitwise_count(bits[block * (_BLOCK // 8) : byte]).sum(dtype=np.int64)
        return int(ranks[block]) + int(inside) + (int(bits[byte]) & ((1 << i % 8) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            out |= int(chunks[i]) << shift
            if not bits[i // 8] >> i % 8 & 1:
                return out
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def tokens(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids begin:end, from the levels' own stretches."""
        end = self.n_tokens if end is None else end
        out = np.zeros(max(0, end - begin), np.uint32)
        at, level = np.arange(len(out)), 0
        while len(at):
            chunks, bits, _ = self.levels[level]
            out[at] |= chunks[begin:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin].astype(bool)
            at = at[more]
            if len(at):
                begin = self._rank(level, begin)
                end, level = begin + len(at), level + 1
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.first[k]), int(self.first[k + 1]))


class _Encoder(IdCache):
    """Ids of texts from the library; each distinct piece is encoded once while the table has room."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids)."""
        for special, number in self.special.items():
            if any(special in x for x in texts):
                parts = [x.split(special) for x in texts]
                count, ids = self([p for x in parts for p in x])
                edge = np.cumsum([0, *map(len, parts)])
                inner = np.ones(len(count), bool)
                inner[edge[1:] - 1] = False  # a special token follows every part but a text's last
                ids = np.insert(ids, np.cumsum(count)[inner], number)
                return np.add.reduceat(count + inner, edge[:-1]), ids
        self.string, points, begin, end, row = pieces(texts)
        return self.ids(self.numbers(points, begin, end), row, len(texts))

    def learn(self, begin: np.ndarray, end: np.ndarray) -> None:
        strings = [self.string[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.int64)
        self.keep(count, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count.sum())))


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write its ids, then `end_id`, in ascending id order under `path`.

    `tokenizer` is the path of a file for the `tokenizers` library, byte-level BPE, readable on every
    executor; no special tokens are added, and its special strings inside texts are handled as the
    library's default. A null text is empty. Rows with a null id are left out; rows of one id stay, by
    their texts, null first.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache("token_store")
        encode = own.get(tokenizer) or own.setdefault(tokenizer, _Encoder(tokenizer))
        part, local = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text"):
            count, ids = encode([x or "" for x in b.column("text").to_pylist()])
            if end_id is not None:
                ids, count = np.insert(ids, np.cumsum(count), end_id), count + 1
            blob = pack_segment(b.column("doc_id").to_numpy(), count, ids)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([local]), pa.array([len(ids)]), pa.array([blob], pa.binary())], ["part", "local", "n_tokens", "segment"])
            local += len(ids)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(of, "part long, local long, n_tokens long, segment binary").write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the segments alone.

    start: ids of all documents before it; ids_crc32: of its ids as little-endian 32-bit integers.
    """
    store = spark.read.schema("part long, local long, n_tokens long, segment binary").parquet(path)
    total = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    base = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = store.join(F.broadcast(base) if total.count() <= SMALL else base, "part")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Segment(b.column("segment")[i].as_buffer().to_pybytes())
                ids, first = s.tokens().astype("<u4"), s.first
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                start = b.column("at")[i].as_py() + first[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids), pa.array(start), pa.array(np.diff(first)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select((F.col("base") + F.col("local")).alias("at"), "segment").mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")
