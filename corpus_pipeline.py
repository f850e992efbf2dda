"""Corpus pipeline: language ID, exact de-duplication, SimHash near-
de-duplication, benchmark decontamination, SentencePiece encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of ``docs``. ``run``
applies them to ``documents``, writing and rereading each one's result.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import anti_rows, materialize, semi_rows, table
from shoplens.llm.decontaminate import contamination
from shoplens.llm.exact_dedup import exact_dedup
from shoplens.llm.language_id import classify, fit
from shoplens.llm.simhash import simhash_groups
from shoplens.llm.unigram import encode_documents, load


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the
    labelled rows of its input."""
    columns = docs.columns
    return classify(docs, fit(docs)).where("not lang_rejected").select([F.col(f"`{c}`") for c in columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of repeated rows one."""
    kept = materialize(exact_dedup(docs).where("kept").select("doc_id", "key"), "exact-kept")
    return semi_rows(docs, kept, once=True)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id, null ids
    last; of rows that share it, the one with the smallest key of its text."""
    kept = materialize(simhash_groups(docs).where("kept").select("doc_id", "key"), "simhash-kept")
    return semi_rows(docs, kept, once=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(found.where("n_hit > 0").select("doc_id", "key"), "contaminated")
    return anti_rows(docs, gone)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document."""
    model = load(tokenizer_path("piece_bpe_32k.model"))
    return encode_documents(docs, model, decode=False).select("doc_id", "ids", "n_tokens")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_dedup", simhash),
          ("decontamination", decontaminate), ("sentencepiece", sentencepiece)]

#: Fingerprints and segmentations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
