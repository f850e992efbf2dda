"""Registered queries of the training-data operators, and the SQL of those that
DuckDB can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import chunk_reuse, oracle
from shoplens.llm.bit_whitening import whiten
from shoplens.llm.chat_format import perspectives
from shoplens.llm.common import table
from shoplens.llm.decontaminate import contamination
from shoplens.llm.exact_dedup import exact_dedup
from shoplens.llm.language_id import classify, fit
from shoplens.llm.line_dedup import line_dedup
from shoplens.llm.simhash import simhash_groups
from shoplens.llm.simplex_clusters import simplex_clusters
from shoplens.llm.substring_dedup import repeats
from shoplens.llm.token_count import token_counts
from shoplens.llm.token_output import read_documents, write_token_files
from shoplens.llm.unigram import encode_documents, load
from shoplens.session import scratch_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(fold != 2))
    return classify(docs, model).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]).cast("long"))
    return found.select("doc_id", "n_words", removed.alias("n_removed"),
                        F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("key")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = encode_documents(docs, load(tokenizer_path("piece_bpe_32k.model")))
    return out.select("doc_id", "ids", "n_tokens", "n_byte_pieces", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("uid")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"token-files-{uuid.uuid4().hex[:12]}")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_documents(spark, path).drop("uid")


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = simplex_clusters(table(spark, sf_dir, "embeddings"))
    hashed = centroids.select("cluster", "cluster_inertia", "inertia", F.sha2(
        F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    # a row per centroid
    return rows.join(F.broadcast(hashed), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # null where the exact deviation is beyond 64 bits
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_reuse.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens",
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_substring_dedup, op3_exact_dedup, op4_chat_format, op5_sentencepiece,
           op6_decontamination, op7_line_dedup, op8_simhash, op9_token_counts, op10_token_output, op11_simplex_clusters,
           op12_bit_whitening, op13_bpe_reuse, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
