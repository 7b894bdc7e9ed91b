"""Views over the driver's tables (FIXTURES.md §3), in Spark and, for the oracle, in DuckDB SQL.

``reviews`` is derived from ``documents`` by a fixed rule, so every registered query reads the given
tables and grows with them. Both definitions must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.functions.text import iso_week
from themelens.session import ensure_parallelism, table_path

REVIEW_EPOCH = "2024-01-01 00:00:00"
REVIEW_SPAN_MINUTES = 40320      # four weeks
REVIEW_STEP = 7919


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


ORD_HORIZON = "2100-01-01 00:00:00"


def order_key(ts="review_ts", source="source", review_id="review_id"):
    """``ord``: newest first, ties by store then id, as one sortable struct.

    It is computed row by row, so no window over a whole product-week is needed: ``min(ord)``,
    ``min_by(x, ord)`` and group-limited ``row_number`` are partial aggregates, safe for a key
    that holds a third of all rows.
    """
    age = F.expr(f"timestampdiff(MICROSECOND, {ts}, timestamp_ntz'{ORD_HORIZON}')")
    return F.struct(age.alias("age"), F.col(source).alias("source"), F.col(review_id).alias("review_id"))


def with_ord(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", order_key())


def reviews(spark: SparkSession, sf_dir: str, with_order: bool = True) -> DataFrame:
    d = ensure_parallelism(table(spark, sf_dir, "documents"))
    out = d.select(
        F.col("source").alias("product_id"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("app_store")).otherwise(F.lit("google_play")).alias("source"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.concat(F.lit("user_"), (F.col("doc_id") % 150).cast("string")).alias("user_name"),
        (F.lit(1) + (F.col("doc_id") * 7) % 5).cast("int").alias("rating"),
        F.col("text").alias("content"),
        F.expr(f"timestampadd(MINUTE, (doc_id * {REVIEW_STEP}) % {REVIEW_SPAN_MINUTES}, "
               f"timestamp_ntz'{REVIEW_EPOCH}')").alias("review_ts"),
    ).withColumn("iso_week", iso_week("review_ts"))
    return with_ord(out) if with_order else out


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as ``(vec_id, vec array<double>, label)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


# ------------------------------------------------------------------------------------------------
# DuckDB side of the same views (the oracle registers the raw tables; these are CTEs over them).
# ------------------------------------------------------------------------------------------------
SQL_VIEWS = {
    "reviews0": f"""
        SELECT source AS product_id,
               CASE WHEN doc_id % 4 = 0 THEN 'app_store' ELSE 'google_play' END AS source,
               CAST(doc_id AS VARCHAR) AS review_id,
               'user_' || CAST(doc_id % 150 AS VARCHAR) AS user_name,
               CAST(1 + (doc_id * 7) % 5 AS INTEGER) AS rating,
               text AS content,
               TIMESTAMP '{REVIEW_EPOCH}' + to_minutes(CAST((doc_id * {REVIEW_STEP}) % {REVIEW_SPAN_MINUTES} AS BIGINT))
                   AS review_ts
        FROM documents""",
    "reviews": f"""
        SELECT *, {{'age': date_diff('microsecond', review_ts, TIMESTAMP '{ORD_HORIZON}'),
                   'source': source, 'review_id': review_id}} AS ord
        FROM (SELECT *, strftime(review_ts, '%G-W%V') AS iso_week FROM reviews0)""",
    "vectors": """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings""",
}

_DEPS = {"reviews": ["reviews0"]}


def sql_with(body: str, *views: str) -> str:
    """``WITH`` the named views (and what they need), then ``body``."""
    order: list[str] = []

    def add(v):
        for dep in _DEPS.get(v, []):
            add(dep)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in order)
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
