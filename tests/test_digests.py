"""Digests of files that no task reads whole."""

import gzip
import hashlib
import random

import pytest

from lekha.plans.queries import QUERIES
from lekha.sources import digests
from lekha.sources.digests import State, file_digests

MB = 1 << 20


@pytest.fixture
def splits(spark):
    """Splits of the given number of bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def _most_read(spark, group) -> int:
    """The bytes that the task of a group of jobs with most of them read."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = [t for s in stages for seq in [store.taskList(s, 0, 1_000)] for t in (seq.apply(i) for i in range(seq.size()))]
    return max(t.taskMetrics().get().inputMetrics().bytesRead() for t in tasks if t.taskMetrics().isDefined())


def test_no_task_reads_a_large_file_whole(spark, tmp_path, splits):
    splits(4 * MB)
    data = random.Random(1).randbytes(40 * MB + 13)
    (tmp_path / "large.parquet").write_bytes(data)
    (tmp_path / "small.parquet").write_bytes(data[:1000])
    spark.sparkContext.setJobGroup("digests", "")
    try:
        got = {tuple(r) for r in QUERIES["asset_bytes"](spark, str(tmp_path)).select("name", "length", "kind", "sha256").collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(name, len(d), d[:4].hex().upper(), hashlib.sha256(d).hexdigest()) for name, d in (("large.parquet", data), ("small.parquet", data[:1000]))}
    assert 3 * MB < _most_read(spark, "digests") < 9 * MB


def test_any_bytes(spark, tmp_path, splits):
    """Line feeds at the ends and in rows, byte order marks, no line feed at all, other line ends, names that look like patterns, packed files."""
    splits(1_000)
    mark = b"\xef\xbb\xbf"
    bodies = [b"a", b"\n", b"\n\n\n", b"a\n", b"\na", b"ab\n\n", b"\r\n\r", mark, mark + b"\n", mark + b"\nx\n", mark + mark + b"y", b"\0" * 3_001, b"\n" * 3_000, bytes(range(256)) * 50, b"x" * 999 + b"\n" + b"y" * 999 + b"\n", b"z" * 1_000 + b"\n" + b"w" * 5_000]
    names = [f"{k} [a]{{b,c}}*?%20.bin" if k % 2 else f"{k}.bin" for k in range(len(bodies))] + ["a [1].gz", "b.bz2"]
    bodies += [gzip.compress(b"a\nb\n" * 1_000), b"not packed"]
    for name, body in zip(names, bodies):
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.kind, r.sha256) for r in file_digests(spark, str(tmp_path), whole=0).collect()}
    assert got == {n: (len(b), b[:4].hex().upper(), hashlib.sha256(b).hexdigest()) for n, b in zip(names, bodies)}


@pytest.mark.parametrize("plain", [False, True])
def test_states(monkeypatch, plain):
    if plain:
        monkeypatch.setattr(digests, "_blocks", lambda: digests._plain)
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 1_000):
        data, state = random.Random(n).randbytes(n), State()
        for at in range(0, n, 37):
            state = state.then(data[at : at + 37])
        assert state.digest() == hashlib.sha256(data).hexdigest()
