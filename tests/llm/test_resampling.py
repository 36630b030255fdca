"""Importance resampling and its table against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekha.llm import interning, resampling

LONG = " ".join(f"w{i % 997}" for i in range(300_000))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=45), max_size=60), st.integers(0, 2**32))
def test_xxh64(runs, seed):
    data = np.frombuffer(b"".join(runs), np.uint8)
    size = np.array([len(r) for r in runs], np.int64)
    end = np.cumsum(size)
    start = end - size
    assert interning.xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(r, seed) for r in runs]


def test_runs_of_one_key_are_told_apart(monkeypatch):
    """Bytes decide, whatever their hashes."""
    monkeypatch.setattr(interning, "xxh64", lambda data, start, end, seed=0: np.full(len(start), 5, np.uint64))
    words = [f"w{i % 23}".encode() for i in range(300)]
    end = np.cumsum([len(w) for w in words])
    x = interning.Interned(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end, 1000)
    assert len(x.used) == 23 and len(set(x.slot.tolist())) == 23
    assert [x.bucket[s] for s in x.slot] == [zlib.crc32(w) % 1000 for w in words]
    assert [x.count[s] for s in x.slot] == [Counter(words)[w] for w in words]


def features(text, orders):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, orders, buckets, percent, least, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, orders)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[k] + 1) * float(s_all) / ((s[k] + 1) * float(t_all)))) for k in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x, orders)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, n >= least and i is not None])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0], -r[2], -r[1]))
    drawn = [(*r[:4], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return sorted(map(repr, drawn + [(*r[:4], None) for r in out if not r[4]]))


@pytest.mark.parametrize(("orders", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 50, 50, 2), (2, 1, 100, 0)])
def test_resample(spark, orders, buckets, percent, least):
    rng = np.random.default_rng(orders)
    docs = [(i, " ".join(rng.choice(["alpha", "BETA", "Gamma7", "é", "中文", "x"], int(rng.integers(0, 60))))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, " .,\n"), (103, LONG), (None, "beta beta"), (104, "x" * 50_000), (5, docs[5][1]), (6, "alpha " * 40)]
    target = ["alpha beta beta", None, "", "Ünder BETA-gamma7"]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate("n bucket weight score rank part place base n_words n_features".split())]).repartition(3)
    to = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(df, to, percent, least, orders, buckets)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(docs, target, orders, buckets, percent, least)
    assert resampling.resample(df.where("false"), to).count() == 0
    assert {r.rank for r in resampling.resample(df.where("doc_id < 9"), to.where("false"), 100, 0).collect()} == set(range(1, 12))
