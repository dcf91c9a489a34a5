"""Stages that turn raw documents into training tokens; each one's rows are written and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evtrail.llm import bpe, decontaminate, pieces, private, simhash
from evtrail.llm.common import drop_written, tuned, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language stay, with the predicted one as lang: a text that is null or has no letter goes."""
    tuned(spark)
    return pieces.determined(docs, pieces.vocabulary_path())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id stays."""
    tuned(spark)
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are the benchmark's go."""
    return decontaminate.clean(docs, tuned(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    tuned(spark)
    return private.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of each document's tokens."""
    tuned(spark)
    return bpe.token_digests(docs, bpe.vocabulary_path())


STAGES = [("language_id", language), ("simhash", near_dedup), ("decontamination", decontaminated), ("pii", redacted), ("bpe", tokens)]
#: Stages hold models and automata that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows go when the next one's are written."""
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
