"""The numbered queries, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.llm import chat, inner_products, main_text, maxent, prefix_trie, resampling, sentence_pieces, simhash, substrings, token_counts, token_store, toxicity, winnowing
from lekha.llm.shared import shared_folder, written

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens"
    token_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), path)
    return token_store.read_store(spark, path)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.main_text(pages, main_text.train(pages))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), digests_only=True)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    back = sentence_pieces.encode(_table(spark, sf_dir, "documents"), model, back=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.CONTROL).alias("text"))
    return chat.digests(written(chat.format_conversations(turns.unionByName(more)), "formatted"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.regrafted(prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_language_model": op2_language_model,
    "op3_simhash": op3_simhash,
    "op4_inner_products": op4_inner_products,
    "op5_main_text": op5_main_text,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_chat_format": op12_chat_format,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op4_inner_products": inner_products.SQL,
    "op7_decontamination": winnowing.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op12_chat_format": chat.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
