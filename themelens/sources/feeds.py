"""Landed store exports (SRC1, SRC2) and their union (SRC3).

The stores are not called from here: a fetcher lands their JSON in shared storage and these readers
flatten it with an explicit schema (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.operators.filters import parse_instant

_LABEL = "struct<label:string>"
APP_FEED_SCHEMA = (
    "feed struct<entry:array<struct<"
    f"id:{_LABEL},author:struct<name:{_LABEL}>,content:{_LABEL},`im:rating`:{_LABEL},updated:{_LABEL}"
    ">>>"
)
PLAY_SCHEMA = "reviewId string, userName string, score int, content string, at string"
CANONICAL = ["source", "review_id", "user_name", "rating", "content", "review_ts"]


def _feed(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return (spark.read.schema(APP_FEED_SCHEMA + ",_corrupt string").option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def app_store_feed_rejects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents of the landed feed that are no JSON of the feed's shape: ``file, record, reason``."""
    raw = _feed(spark, path, multi_line).withColumn("file", F.input_file_name())
    # the record must be read together with the fields, or Spark skips parsing
    bad = raw.where(F.col("_corrupt").isNotNull() | F.col("feed").isNull())
    return bad.select("file", F.col("_corrupt").alias("record"),
                      F.when(F.col("_corrupt").isNotNull(), F.lit("not JSON")).otherwise(F.lit("no feed")).alias("reason"))


def read_app_store_feed(spark: SparkSession, path: str, as_of: str, multi_line: bool = True) -> DataFrame:
    """SRC1: flatten ``feed.entry[]``. Entries without ``author`` are skipped; defaults: content
    ``''``, rating 0 (also for a malformed rating), user ``'Unknown'``, id ``''``; dates with an
    offset are instants, without one UTC; an unparsable or missing date becomes ``as_of``. A landed file
    is one document unless ``multi_line`` is off (one document per line); unreadable documents are in
    ``app_store_feed_rejects``."""
    raw = _feed(spark, path, multi_line)
    e = raw.select(F.explode_outer("feed.entry").alias("e")).where(F.col("e").isNotNull())
    e = e.where(F.col("e.author").isNotNull())
    return e.select(
        F.lit("app_store").alias("source"),
        F.coalesce(F.col("e.id.label"), F.lit("")).alias("review_id"),
        F.coalesce(F.col("e.author.name.label"), F.lit("Unknown")).alias("user_name"),
        F.coalesce(F.expr("try_cast(trim(e.`im:rating`.label) AS INT)"), F.lit(0)).alias("rating"),
        F.coalesce(F.col("e.content.label"), F.lit("")).alias("content"),
        F.coalesce(parse_instant(F.col("e.updated.label")), parse_instant(F.lit(as_of))).alias("review_ts"))


def read_play_reviews(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: rename the Play export's fields to the canonical columns."""
    raw = spark.read.schema(PLAY_SCHEMA).json(path)
    return raw.select(
        F.lit("google_play").alias("source"), F.col("reviewId").alias("review_id"),
        F.col("userName").alias("user_name"), F.col("score").alias("rating"), "content",
        parse_instant(F.col("at")).alias("review_ts"))


def unify_reviews(*frames: DataFrame) -> DataFrame:
    """SRC3: bag union of the store sources (no dedup; that is D1's job)."""
    out = frames[0].select(*CANONICAL)
    for f in frames[1:]:
        out = out.unionByName(f.select(*CANONICAL))
    return out
