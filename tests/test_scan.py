"""Degenerate orders: the fold, and reorder with it, against a scan over lists of characters, in Spark and in DuckDB."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lekha.functions import bangla as B
from lekha.functions import scan
from lekha.functions import script as S
from lekha.plans.queries import _reorder

ALPHABET = "কষরয্্িেুড়‌অa "


def consonant(c):
    return re.fullmatch(f"[{S.CONSONANTS}]", c) is not None


def scanned(line):
    """One line, character by character. `floor` is where the last move ended; it raises on inputs that a strict reader rejects."""
    text, floor, at = list(line), 0, 0

    def look(k):
        if not 0 <= k < len(text):
            raise IndexError(k)
        return text[k]

    while at < len(text):
        if text[at] in S.PRE_KAR:
            to = at - 1
            while consonant(look(to)) and to > floor and look(to - 1) == S.HALANT:
                to -= 2
            text.insert(to, text.pop(at))
            floor = at + 1
        if text[at] == S.HALANT and at + 1 < len(text) and look(at - 1) == S.RA and look(at - 2) != S.HALANT:
            end = at + 1
            while consonant(look(end)) and look(end + 1) == S.HALANT:
                end += 2
            signs = [text[end + 1]] if consonant(text[end]) and look(end + 1) in S.PRE_KAR else []
            text[at - 1 : end + 1 + len(signs)] = [*signs, *text[at + 1 : end + 1], S.RA, S.HALANT]
            at = end + len(signs)
            floor = at + 1
        at += 1
    return "".join(text)


def made(n, longest, seed):
    """Random lines that a strict reader takes, with what becomes of them."""
    rng, out = random.Random(seed), {}
    while len(out) < n:
        line = "".join(rng.choices(ALPHABET, k=rng.randint(1, longest)))
        try:
            out[line] = scanned(line)
        except IndexError:
            pass
    return out


@pytest.mark.parametrize(("n", "longest"), [(60_000, 9), (40_000, 24), (60, 3000)])
def test_reorder_is_the_scan(spark, n, longest):
    cases = made(n, longest, longest)
    odd = sum(re.search(scan.DEGENERATE, t) is not None for t in cases)
    assert odd and (longest > 9 or odd < n)
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").repartition(4)
    got = rows.select("t", "want", B.reorder(F.col("t")).alias("got"), scan.fold(F.col("t")).alias("folded"))
    assert got.where("got != want or folded != want").limit(3).collect() == []


def test_sql_says_the_same_of_all_inputs(spark):
    """Also of those that a strict reader rejects, and over several lines."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET + "\n", k=rng.randint(0, 30))) for _ in range(4000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.o for r in rows.select("i", B.reorder(F.col("t")).alias("o")).orderBy("i").collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE x AS SELECT unnest($1) AS t, unnest(range(len($1))) AS i", [texts])
    assert got == [r[0] for r in c.execute(f"SELECT {_reorder('t')} FROM x ORDER BY i").fetchall()]
    assert all(sorted(a) == sorted(b) for a, b in zip(got, texts))  # nothing but the order changes


@pytest.mark.parametrize("text", ["্" * 100_000, "ক" + "িে" * 50_000, "কর্" + "ক্" * 200_000 + "িে", "কর্কর্" * 30_000, "ক" * 300_000 + "্িক", "রি্ক" * 50_000])
def test_long_degenerate_texts(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(B.reorder(F.col("t")).alias("o")).first()
    assert len(row.o) == len(text) and (text[0] == S.HALANT or len(text) > 400_000 or row.o[:200] == scanned(text[:400] + "ক ")[:200])
