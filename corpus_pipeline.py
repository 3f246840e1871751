"""A training corpus from raw documents: language ID, near-dedup, passage dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the shared folder
and reads them again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fespan.llm import decontaminate, langid, mixing, simhash, suffixdedup
from fespan.llm.common import materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter and those under the calibrated threshold go."""
    return langid.identify(docs, langid.fit(docs), accepted_only=True)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; one of a group without ids stays too."""
    return simhash.keep_one(docs, null_ids=True)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that begin in an earlier document too; n_chars follows."""
    return suffixdedup.cut_documents(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not contaminate."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), only_clean=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [("language", known_language), ("simhash", one_of_near_copies), ("suffix_array", passages_once), ("decontaminate", no_benchmark), ("mix", mixed)]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
