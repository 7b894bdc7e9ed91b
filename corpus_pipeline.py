"""The corpus pipeline: documents in, token ids out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Each stage calls one operator of ``themelens.llm`` on every row that its predecessor kept:

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of similarity ``SIMILAR`` (0.8) or more stays (the smallest id).
3. decontamination: documents that hold ten consecutive words of a benchmark item go.
4. pii: confirmed spans are replaced by tags; ``n_chars`` follows the text.
5. sentencepiece: token ids of every text.

Null or empty texts pass through every stage with the result that the operators define. There is no SQL form
(model fitting, MinHash); tests compare stages 2 to 5 with plain Python forms, the quality decisions being given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.llm.decontamination import drop_contaminated
from themelens.llm.near_duplicates import drop_near_duplicates
from themelens.llm.pii import redact
from themelens.llm.quality import keep_good
from themelens.llm.sentencepiece_unigram import MODEL, Vocabulary, encode_column
from themelens.session import free_name, stage, table_path

SIMILAR = 80                # per cent, of five-word shingles; query op10 has its own threshold


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, similar=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "_clean")
    clean = docs.withColumn(name, redact(F.col("text")))
    changed = ~F.col(name).eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length(name).cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).withColumn("text", F.col(name)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_column(docs.select("doc_id", "lang", "source", "text"), Vocabulary(MODEL))
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again but for the last."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
