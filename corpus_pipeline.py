"""A training-corpus pipeline: each stage reads what the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of `documents`. A row without a doc_id goes by a hash of its text, and
keeps its null; rows that share a doc_id are documents of their own where their texts differ.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.llm import sentence_pieces, simhash, substrings, toxicity, winnowing
from lekha.llm.queries import PIECES
from lekha.llm.shared import made, release, written


def _key() -> Column:
    return F.coalesce("doc_id", F.xxhash64("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id (or a hash of the text), text and one column with all but the text, whatever they are called."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(_key().alias("doc_id"), "text", F.struct(*rest).alias("lk_rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c if c == "text" else F.col("lk_rest").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject."""
    models = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = toxicity.toxicity(_packed(docs), models, keep=("text", "lk_rest"))
    return _unpacked(rated.where("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    key, version = _key().alias("lk_key"), F.xxhash64("text").alias("lk_version")
    groups = simhash.similar_documents(docs.select(_key().alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").groupBy("group", "component_id").agg(F.min("version").alias("lk_version"))
    first = first.select(F.col("component_id").alias("lk_key"), "lk_version")
    rows = groups.groupBy(F.col("doc_id").alias("lk_key"), F.col("version").alias("lk_version")).count()
    first = written(first.distinct().join(rows, ["lk_key", "lk_version"]), "first")
    keyed, on = docs.select("*", key, version), ["lk_key", "lk_version"]
    once = keyed.join(first.where("count = 1").select(on), on, "left_semi")
    again = keyed.join(first.where("count > 1").select(on), on, "left_semi").dropDuplicates(on)  # rows with one id and text
    return once.unionByName(again).select([F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand earlier in the corpus; a document of nothing else goes."""
    cut = substrings.remove_repeats(_packed(docs), keep=("lk_rest",))
    changed, rest = F.col("n_removed") > 0, F.col("lk_rest")
    if "n_chars" in docs.columns:
        rest = rest.withField("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(rest["n_chars"]))
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    out = cut.where(~(changed & (F.col("n_removed") == F.col("n_words"))))
    return _unpacked(out.select("doc_id", text.alias("text"), rest.alias("lk_rest")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    judged = winnowing.contamination(docs.select(F.struct(_key(), F.xxhash64("text")).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.where("contaminated").select(F.col("doc_id.*")).toDF("lk_key", "lk_version").distinct()
    keyed = docs.select("*", _key().alias("lk_key"), F.xxhash64("text").alias("lk_version"))
    return keyed.join(bad, ["lk_key", "lk_version"], "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and what they decode to, as digests besides the ids."""
    model = public_tokenizers.path(PIECES)
    back = sentence_pieces.encode(docs, model, back=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("contamination", drop_contaminated),
    ("sentence_pieces", encode_pieces),
]

#: No SQL says what trained models, components or pieces do; tests compare the stages and run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next; what a stage needed besides goes when it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
