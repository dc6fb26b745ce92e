"""A corpus pipeline of five stages over documents; each stage's table is the next one's input.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns.
Texts are never cut, and all stages but the last return the columns that they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonlake.llm import common, decontamination, jaccard, mixing, records, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null and empty texts are clean and stay; rows with a null doc_id are scored as others; equal rows go or stay
    together; without labels nothing goes.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Of rows with one doc_id one stays; documents without words and rows with a null doc_id have no near duplicates and
    stay.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go.

    Null and empty texts share none; rows with a null doc_id are told apart by their texts; with an empty benchmark
    nothing goes.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of its source takes it.

    Texts without words have no size and are taken at their source's rate; a null source is the last one; equal rows
    are taken together, and reruns take the same rows.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of what the mix took, in order of doc_id, null doc_ids first.

    Repeated documents are records of their own; a null or empty text is the end id alone.
    """
    return records.token_records(docs, cached_words=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_records", write_tokens),
]
#: Toxicity is a trained model and tokens are a vocabulary's; no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = common.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.stage(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
