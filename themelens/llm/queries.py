"""The registered queries of the training-data operators: ``opN_<name>(spark, sf_dir)``, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.llm import oracle
from themelens.llm.collocations import collocations
from themelens.llm.decontamination import contamination_digest
from themelens.llm.exact_duplicates import exact_duplicates_digest
from themelens.llm.licenses import license_scan
from themelens.llm.near_duplicates import near_duplicates
from themelens.llm.periodic_runs import runs_digest
from themelens.llm.pii import pii_digest
from themelens.llm.quality import quality_scores
from themelens.llm.secrets import secrets_digest
from themelens.llm.sentencepiece_unigram import MODEL, Vocabulary, round_trip
from themelens.llm.sharding import shard_documents
from themelens.llm.substrings import repeats_digest
from themelens.llm.topk import top_k
from themelens.session import table_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(_read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the round trip: the digest of what they decode to, and whether it is the text."""
    both = round_trip(_read(spark, sf_dir, "documents"), Vocabulary(MODEL))
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
                       "decoded_sha256", "round_trip")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates_digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_quality, op3_secrets, op4_sentencepiece, op5_decontamination, op6_pii, op7_sharding, op8_top_k,
                                       op9_substrings, op10_near_duplicates, op11_periodic_runs, op12_collocations,
                                       op13_exact_duplicates)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle()
