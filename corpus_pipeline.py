"""A corpus pipeline of five stages, each the whole result of the one before.

Rows that language ID rejects go; repeated lines go from the texts; one document of each SimHash group stays; documents
with words of benchmark windows go; what is left is packed into token windows. Every stage is written as Parquet in the
shared folder and read again as the next one's ``docs``, so a lost executor never costs more than a stage.

Rows are judged one by one: repeated ids, missing ids, null and empty texts follow each stage's own rules (see its operator), an
empty table gives an empty result, and columns beside those of ``documents`` are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meetspark.llm import decontaminate, language_id, line_dedup, packing, simhash
from meetspark.llm.storage import saved, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_documents(docs.select(COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(docs.select(COLUMNS))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmarks), ("packing", windows)]

#: SQL has no SimHash, tokenizer or n-gram model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with scope(spark):  # a stage's own tables go once its result is written
            docs = saved(stage(spark, docs, sf_dir), f"stage{i}", keep=True)
    return docs
