"""What keeps the cost of large tables in proportion."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lekha.functions import bangla as B
from lekha.functions import scan
from lekha.functions import script as S
from lekha.plans.queries import QUERIES
from lekha.sources.readers import spread


@pytest.mark.parametrize("name", ["paragraph_spans", "table_spans", "table_width_spans", "rich_text_spans", "spans_by_font", "header_spans"])
def test_spans_are_made_once(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]


def _parts(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_one_row_group_is_spread_though_its_file_has_many_splits(spark, tmp_path):
    n = 8_000
    pq.write_table(pa.table({"i": list(range(n)), "t": [f"text {i * 7919 % 10007}" * 60 for i in range(n)]}), tmp_path / "t.parquet", row_group_size=n, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert df.rdd.getNumPartitions() >= 4 and _parts(df) == [n]
        out = spread(df)
        assert len(_parts(out)) == 16 and max(_parts(out)) < n / 4
        assert sorted(r.i for r in out.collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_tables_stay(spark, folder):
    df = spark.read.parquet(f"{folder}/part.parquet")
    assert spread(df) is df


def test_marked_words_equal_words_one_by_one(spark):
    """Degenerate words at the begin, at the end, next to each other, after halants and spaces, and in a text that holds the mark."""
    odd = "রে্িে"
    texts = ["", " ", "ক", odd, f"{odd} {odd}", f" {odd}  {odd} ", f"ক্ {odd}্ ক x", f"a b\n{odd}\n{odd}", f"কি {odd} কি" * 300, f"র্ {odd}র্"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = df.select(scan.guarded(F.col("t")).alias("a"), scan.guarded(F.concat(F.col("t"), F.lit(f" {S.GUARD}"))).alias("b")).collect()
    for a, b in got:
        assert (a is None and b is None) or b == f"{a} {S.GUARD}"


def test_bases_of_signs(spark):
    """What a sign goes before: any character but a guard and a line feed, whole if it is of two UTF-16 units."""
    cases = {"xি": "িx", "\nি": "\nি", f"{S.GUARD}ি": f"{S.GUARD}ি", " ি": "ি ", "\rি": "ি\r", "\U0001f600ি": "ি\U0001f600", f"{S.GUARD}্কি": f"{S.GUARD}্িক", "\n্কি": "\n্িক"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", B.reorder_pre_kar(F.col("t")).alias("o")).collect()} == cases
