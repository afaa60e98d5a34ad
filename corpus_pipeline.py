"""The corpus pipeline: documents through five of the text operators.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of documents, whatever else they are called.

Defined results: null, empty and very short texts fail the quality rules and go;
very long texts are judged and rewritten whole; of near duplicates, repeated rows
among them, one row stays, and two different texts under one doc_id are told
apart; rows without a doc_id all stay; a text that is a passage or personal data
altogether becomes empty or a mark and stays a row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracell.llm import decontaminate, pair_bpe, pii, quality, simhash
from veracell.llm.common import Scratch, id_and_text


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. The ledger is evaluated beside
    the row it judges, so nothing is shuffled."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    out = decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    out = pii.redact_text(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes and the ids themselves."""
    return pair_bpe.encode(id_and_text(docs), ids=True)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark_passages),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: SQL has neither the linking of fingerprints nor the merges of a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
