"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read by the next.

Every stage takes any documents table with doc_id and text and returns its columns (the last one: pieces of sequences).
Null and empty texts: scored as empty, one empty line, one class of near-duplicates, without passages, one closing id.
Null doc_ids: such rows are judged and kept like others, and count after all others where a first one is chosen.  Repeated
rows: scored one by one; keep each other's lines; near-dedup keeps one of rows equal in doc_id and text, and judges rows
that share a doc_id by their own texts.  Ties go to the smaller doc_id.  Texts of any length are taken whole.  An empty table
gives an empty one.  Other columns are carried along whatever their names; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.line_dedup import dedup_lines
from schemaloom.llm.minhash import keep_first
from schemaloom.llm.packing import pack
from schemaloom.llm.quality import featured, fit, score_documents
from schemaloom.llm.spark_util import small_batches, written
from schemaloom.llm.suffix import remove_repeats


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars (where there is one) brought up to date."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (op 8)."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(featured(docs), labels)
    return score_documents(docs, model).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds (op 3)."""
    small_batches(spark)
    return _as_documents(dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (op 6)."""
    small_batches(spark)
    return keep_first(docs).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place holds (op 1)."""
    small_batches(spark)
    return _as_documents(remove_repeats(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens (op 7): one row per piece."""
    small_batches(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", passages), ("best-fit packing", packing)]

#: The stages learn, sample hashes and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
