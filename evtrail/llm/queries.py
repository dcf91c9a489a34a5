"""The queries of this subpackage: opN_<name>, each over its whole table with the parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, exact, passages, pieces, private, simhash, sql, suffixes, topk, toxicity, variants
from .common import documents, tuned


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(documents(spark, sf_dir))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(documents(spark, sf_dir))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.language_report(documents(spark, sf_dir), pieces.vocabulary_path())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(documents(spark, sf_dir), pieces.vocabulary_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), bpe.vocabulary_path())


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(documents(spark, sf_dir))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffixes": sql.OP1, "op5_passages": sql.OP5, "op8_decontaminate": sql.OP8, "op10_topk": sql.OP10, "op11_variants": sql.OP11, "op12_collocations": sql.OP12, "op13_exact": sql.OP13}
