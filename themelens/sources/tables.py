"""Stored tables (SRC4-SRC7): Parquet/text in shared storage, partitioned by product and week.

Writes go to new directories or append; nothing is overwritten while it is being read (SRC5 writes
a new snapshot and returns its path)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens import KEYS
from themelens.functions.text import report_anchor


#: Stored tables are read with their schema: inference would turn a product id like 0071404 into a number.
REVIEW_SCHEMA = ("product_id string, iso_week string, source string, review_id string, user_name string, rating int, "
                 "content string, review_ts timestamp_ntz")
SUMMARY_SCHEMA = "run_id string, product_id string, iso_week string, summary_json string, created_at timestamp_ntz"
COUNTS_SCHEMA = "n_docs long, counts array<long>, iso_week string"
REPORT_SCHEMA = "value string, product_id string, iso_week string"


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a product-week together before a partitioned write, so a task writes few files; Spark splits
    the partitions of a large product-week (and joins small ones) by size."""
    return df.hint("rebalance", *[F.col(k) for k in KEYS])


def append_reviews(df: DataFrame, path: str) -> None:
    """SRC4 (write): append a run's scrubbed reviews, partitioned by product and week."""
    _dealt(df).write.mode("append").partitionBy(*KEYS).parquet(path)


def load_reviews(spark: SparkSession, path: str, extra_columns: str = "") -> DataFrame:
    """SRC4 (read): the whole review log; partition filters prune directories. ``extra_columns`` is DDL of
    columns that the caller stored besides the canonical ones."""
    return spark.read.schema(REVIEW_SCHEMA + (", " + extra_columns if extra_columns else "")).parquet(path)


def upsert_runs(runs: DataFrame, changes: DataFrame, root: str, keys=KEYS) -> str:
    """SRC5: insert-or-replace by ``(product_id, iso_week)``: the new row wins whole. What it leaves unset
    takes its default: ``run_id`` the report anchor (S3), ``status`` PENDING, ``created_at`` the time of the
    call, others null. Several changes of one key are one row: the latest ``created_at``, then the greatest
    values. Written as a new snapshot under ``root``; returns its path."""
    cols = runs.columns
    defaults = {"run_id": report_anchor(*keys), "status": F.lit("PENDING"), "created_at": F.current_timestamp()}

    def value(c: str):
        kind = runs.schema[c].dataType
        fallback = defaults.get(c, F.lit(None)).cast(kind)
        return (F.coalesce(F.col(c).cast(kind), fallback) if c in changes.columns else fallback).alias(c)

    new = changes.select(*[value(c) for c in cols])
    rest = [c for c in ["created_at", *[c for c in cols if c != "created_at"]] if c in cols and c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in cols])
    snap = runs.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    snap.write.parquet(path)
    return path


def write_document_counts(counts: DataFrame, path: str) -> None:
    """Stored document counts of M1, one row per week: a run replaces the weeks that it has counted and leaves
    the others, so it may be repeated."""
    (counts.select("n_docs", "counts", "iso_week").hint("rebalance", F.col("iso_week"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iso_week").parquet(path))


def load_document_counts(spark: SparkSession, path: str) -> DataFrame:
    """Stored document counts; a filter on the week prunes directories."""
    return spark.read.schema(COUNTS_SCHEMA).parquet(path)


def append_summaries(summaries: DataFrame, path: str) -> None:
    """SRC6: the nested summary as JSON text with its run id and time (``to_json`` only here)."""
    body = F.to_json(F.struct("product_id", "iso_week", "data_window", "top_themes", "total_reviews_analyzed",
                              "metrics", "generated_at"))
    summaries.select("run_id", *KEYS, body.alias("summary_json"),
                     F.col("generated_at").alias("created_at")).write.mode("append").partitionBy(*KEYS).parquet(path)


def load_summaries(spark: SparkSession, path: str) -> DataFrame:
    """SRC6 (read): stored summaries, with their schema."""
    return spark.read.schema(SUMMARY_SCHEMA).parquet(path)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC7 (read): the whole text of each stored report, as ``product_id, iso_week, markdown``."""
    rows = spark.read.schema(REPORT_SCHEMA).text(path, wholetext=True)
    return rows.select(*KEYS, F.col("value").alias("markdown"))


def write_reports(reports: DataFrame, path: str, text_col: str = "markdown") -> None:
    """SRC7: one text document per product-week (a new folder per run keeps the history)."""
    reports.select(*KEYS, text_col).write.mode("append").partitionBy(*KEYS).text(path)
