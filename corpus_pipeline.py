"""The corpus pipeline: documents go through STAGES, each written as Parquet and read again as the next one's input.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; the last returns doc_id, n_tokens and ids.
SQL can't express the stages; their tests compare them with brute force.

Defined cases: documents with a null or empty text, or one without a letter, go in the first stage. A document with a null doc_id is kept by every stage that keeps
its text: it is linked with nothing, but a benchmark item in it makes it go. Of rows that repeat a doc_id and a text one stays. Equal texts under several doc_ids
leave the least. Columns other than doc_id and text pass through, whatever their names; n_chars is counted anew where a passage was cut, and a null lang is
filled. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import bpe, common, decontaminate, language_id, near_dedup, substring_dedup

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = common.written(function(spark, docs, sf_dir), name)
    return docs
