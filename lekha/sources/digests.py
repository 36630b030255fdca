"""SHA-256 of files of any size: no task reads more than one split of one."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of at most so many bytes are read whole, many at a time; larger ones by their splits, one after the other.
WHOLE_BYTES = 32 << 20

#: Files that readers of lines unpack by their names; these are read whole, whatever their size.
_PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$")

#: What readers of lines leave out where a file begins with it.
_MARK = b"\xef\xbb\xbf"


class State(NamedTuple):
    """Where a digest stands after `n` bytes: the eight words, the bytes that fill no block yet, the file's first bytes."""

    words: tuple[int, ...] = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
    n: int = 0
    rest: bytes = b""
    head: bytes = b""

    def then(self, data: bytes) -> State:
        whole = self.rest + data
        cut = len(whole) - len(whole) % 64
        return State(_blocks()(self.words, whole[:cut]) if cut else self.words, self.n + len(data), whole[cut:], (self.head + data[:4])[:4])

    def digest(self) -> str:
        end = self.rest + b"\x80" + b"\0" * ((55 - self.n) % 64) + struct.pack(">Q", 8 * self.n)
        return struct.pack(">8I", *_blocks()(self.words, end)).hex()


def _plain(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    """The eight words after whole blocks: the standard's loop."""
    turned = lambda x, k: x >> k | x << 32 - k & 0xFFFFFFFF
    for at in range(0, len(data), 64):
        w = list(struct.unpack_from(">16I", data, at))
        for i in range(16, 64):
            a, b = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (turned(a, 7) ^ turned(a, 18) ^ a >> 3) + w[i - 7] + (turned(b, 17) ^ turned(b, 19) ^ b >> 10) & 0xFFFFFFFF)
        a, b, c, d, e, f, g, h = words
        for k, x in zip(_roots(), w):
            s = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + (e & f ^ ~e & g) + k + x
            t = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = s + t & 0xFFFFFFFF, a, b, c, d + s & 0xFFFFFFFF, e, f, g
        words = tuple(x + y & 0xFFFFFFFF for x, y in zip(words, (a, b, c, d, e, f, g, h)))
    return words


@cache
def _roots() -> list[int]:
    """32 bits after the point of the cube roots of the first 64 primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
    out = []
    for p in primes:
        x = int(round((p << 96) ** (1 / 3)))
        while x**3 > p << 96:
            x -= 1
        while (x + 1) ** 3 <= p << 96:
            x += 1
        out.append(x & 0xFFFFFFFF)
    return out


@cache
def _blocks() -> Callable[[tuple[int, ...], bytes], tuple[int, ...]]:
    """The same by the library that hashlib uses, whose digests cannot be handed on; the plain loop where it cannot be called."""
    try:
        import _hashlib
        import ctypes

        update = ctypes.CDLL(_hashlib.__file__).SHA256_Update
        update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)

        def fast(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
            context = (ctypes.c_uint32 * 64)(*words)  # eight words, length, block, bytes in it, size of the digest
            context[27] = 32
            update(context, data, len(data))
            return tuple(context[:8])

        sample = bytes(range(256)) * 3
        if fast(State().words, sample) == _plain(State().words, sample):
            return fast
    except (ImportError, AttributeError, OSError):
        pass
    return _plain


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lines = pa.ListArray.from_arrays([0, batch.num_rows], batch.column(0))
            yield pa.record_batch([pc.binary_join_element_wise(b"", pc.binary_join(lines, b"\n"), b"\n")], ["piece"])


def _taken(states: dict[int, State]) -> Callable:
    """A split's pieces taken up by the state of its file, whose first line has no line feed before it."""

    def take(split: int, rows: Iterator) -> Iterator[tuple[int, State]]:
        state, first = states[split]
        for (piece,) in rows:
            state, first = state.then(bytes(piece[1:] if first else piece)), False
        yield split, (state, first)

    return take


def _literal(path: str) -> str:
    """A path as a pattern that only it fits."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


def large_digests(spark: SparkSession, files: dict[str, int]) -> dict[str, tuple[str, str]]:
    """path -> (first four bytes, SHA-256), both in hexadecimal, of files whose lengths are given.

    Spark splits a file that it reads as lines, and gives the bytes between line feeds as they are. All splits are
    read side by side and kept on the executors' disks, as reading costs most. Then a round takes the next split of
    each file, each in a task of its own from the state after the split before; the driver holds a state for each
    file. The bytes taken are counted: one less than the length is a line feed at the end, three less again a byte
    order mark at the begin, which readers leave out, so that the file is taken once more after it. A line is read by
    one task whatever its length, and lines of over 2 GB fail.
    """
    lines = lambda path: spark.read.text(_literal(path), lineSep="\n").select(F.col("value").cast("binary"))
    todo, done = {path: State() for path in files}, {}
    while todo:
        parts = {path: lines(path).mapInArrow(_pieces, "piece binary").rdd for path in todo}  # their splits stay as they are here
        counts = [rdd.getNumPartitions() for rdd in parts.values()]
        starts = dict(zip(todo, accumulate(counts, initial=0)))
        everything = spark.sparkContext.union(list(parts.values())).persist(StorageLevel.DISK_ONLY)
        states = {path: (state, True) for path, state in todo.items()}
        try:
            everything.foreachPartition(lambda rows: None)
            for k in range(max(counts)):
                at = {starts[path] + k: path for path, n in zip(todo, counts) if k < n}
                taken = everything.mapPartitionsWithIndex(_taken({i: states[path] for i, path in at.items()}))
                for i, state in spark.sparkContext.runJob(taken, list, list(at)):
                    states[at[i]] = state
        finally:
            everything.unpersist()
        again = {}
        for path, (state, _) in states.items():
            if state.n == files[path] - 1:
                state = state.then(b"\n")
            if state.n == files[path]:
                done[path] = state.head.hex().upper(), state.digest()
            elif todo[path] == State():
                again[path] = State().then(_MARK)
            else:
                raise ValueError(f"{path}: {state.n} of {files[path]} bytes")
        todo = again
    return done


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, kind, sha256) of a folder's files, save empty ones, which Spark does not list: kind is the first four bytes in hexadecimal."""
    reader = spark.read.format("binaryFile")
    of = lambda df: df.select("path", "length", F.hex(F.substring("content", 1, 4)).alias("kind"), F.sha2("content", 256).alias("sha256"))
    assets = reader.option("pathGlobFilter", pattern).load(folder)
    out = of(assets.where(F.col("length") <= whole))
    large = {r.path: r.length for r in assets.where(F.col("length") > whole).select("path", "length").collect()}
    if packed := [_literal(path) for path in large if _PACKED.search(path)]:
        out = out.unionByName(of(reader.load(packed)))
    if files := {path: n for path, n in large.items() if not _PACKED.search(path)}:
        found = large_digests(spark, files)
        out = out.unionByName(spark.createDataFrame([(path, n, *found[path]) for path, n in files.items()], "path string, length long, kind string, sha256 string"))
    return out
