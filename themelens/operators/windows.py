"""Top-k, ordering and dedup operators.

Top-k windows use ``row_number() <= n``; Catalyst plans them with ``WindowGroupLimit`` so each map
task keeps only its first ``n`` rows per group before the shuffle, and a hot group never reaches
one task whole. Operators that need the *single* best row per group use ``max_by``/``min_by``
aggregates instead (partial aggregation), never a full-group window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens import KEYS


def top_n(df: DataFrame, partition, order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def top_clusters(sizes: DataFrame, n: int = 5, keys=KEYS) -> DataFrame:
    """Clusters by size desc, ties by first-seen review (``min_ord``), first ``n``."""
    return top_n(sizes, keys, [F.col("size").desc(), F.col("min_ord")], n)


def top_terms(counts: DataFrame, n: int = 10, keys=KEYS) -> DataFrame:
    """The ``n`` most frequent words per cluster, ties by first occurrence."""
    return top_n(counts, [*keys, "cluster_id"], [F.col("count").desc(), F.col("first_pos")], n,
                 rank_col="term_rank")


def sample_first(df: DataFrame, n: int, keys=KEYS, group: str = "cluster_id") -> DataFrame:
    """First ``n`` reviews of each cluster in review order (40 per prompt, 20 in the older one)."""
    return top_n(df, [*keys, group], [F.col("ord")], n, rank_col="pos")


def newest_n(df: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Newest ``n`` reviews per key (300 in a run, 500 by default)."""
    return top_n(df, keys, [F.col("review_ts").desc(), F.col("source"), F.col("review_id")], n,
                 rank_col="recency")


def take_until_older(df: DataFrame, cutoff, keys=KEYS, ts_col: str = "review_ts") -> DataFrame:
    """In source order (``ord``), keep rows before the first one older than ``cutoff``.

    The first old row per key is a partial ``min`` aggregate; rows are kept if they come before
    it. Same answer as a running max, without sorting a whole key in one task."""
    cut = F.lit(cutoff).cast("timestamp_ntz") if not isinstance(cutoff, Column) else cutoff
    first_old = (df.where(F.col(ts_col) < cut).groupBy(*keys)
                   .agg(F.min("ord").alias("_first_old")))
    return (df.join(first_old, list(keys), "left")
              .where(F.col("_first_old").isNull() | (F.col("ord") < F.col("_first_old")))
              .drop("_first_old"))


def latest_per(df: DataFrame, partition, order_col: str, tie_col: str | None = None) -> DataFrame:
    """One newest row per group, as a ``max_by`` aggregate (map-side combine, skew-safe). Ties on
    ``order_col`` break on ``tie_col``, else on a hash of the whole row, so the pick is
    deterministic however the rows are partitioned."""
    cols = [c for c in df.columns]
    tie = F.col(tie_col) if tie_col else F.xxhash64(*[F.col(c) for c in cols])
    order = F.struct(F.col(order_col), tie)
    picked = df.groupBy(*partition).agg(F.max_by(F.struct(*cols), order).alias("_row"))
    return picked.select("_row.*")


def latest_summary(summaries: DataFrame, run_id: str | None = None,
                   per: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Newest summary per product (optionally of one run)."""
    if run_id is not None:
        summaries = summaries.where(F.col("run_id") == F.lit(run_id))
    return latest_per(summaries, list(per), "generated_at", "run_id")


def dedup_reviews(stored: DataFrame, version_col: str = "scraped_at") -> DataFrame:
    """Latest copy per ``(source, review_id)``. A group of copies may be huge (forced re-runs
    insert again), so this is a ``max_by`` aggregate, not a window."""
    return latest_per(stored, ["source", "review_id"], version_col)
