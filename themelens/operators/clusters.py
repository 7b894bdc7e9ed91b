"""Clustering (M3-M7).

M3 takes the longest-lived clusters of the density hierarchy (``hierarchy``), or cuts it at one ``eps``: core
distances from J7's kNN, spanning-tree edges by mutual reachability, connected components by star
contraction on DataFrames, then a size filter. Each round is written as a table in the shared checkpoint folder (``stage``), which
cuts the lineage like a reliable checkpoint, so a lost executor restarts from the last round, not
from the first (and, unlike an uncached ``checkpoint()``, the round is computed only once).
"""

from __future__ import annotations

import warnings

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions.text import keyword_group
from themelens.operators.aggregates import needs_fallback
from themelens.operators.hierarchy import core_distances, hierarchical_labels, labels_of_edges
from themelens.operators.vectors import similar_pairs, spanning_edges, usable_vectors, windowed_spanning_edges
from themelens.session import checked_broadcast, drop_staged, stage


def connected_components(nodes: DataFrame, edges: DataFrame, keys=()) -> DataFrame:
    """Label each node with the smallest node id of its component (ids of any orderable type).

    ``nodes``: keys, ``id``. ``edges``: keys, ``src``, ``dst`` (either direction). Alternating large-star
    and small-star: each round links every node's larger (then smaller) neighbours to the smallest node it
    knows, until the edges no longer change; rounds grow with the logarithm of the graph, and there is no
    limit on them. A step is a grouped minimum and a join of the edges with one row per node, so a giant
    component only skews the edge side, which Spark splits. Each round is written to the shared folder and
    the one before it deleted."""
    keys = list(keys)
    u, v = F.col("u"), F.col("v")
    spark = nodes.sparkSession
    now = stage(edges.select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
                .where(u > v).distinct(), "cc-edges")
    before = None
    while True:
        both = now.unionByName(now.select(*keys, v.alias("u"), u.alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = stage(both.where(v > u).join(least, [*keys, "u"]).select(*keys, v.alias("u"), F.col("m").alias("v"))
                      .where(u != v).distinct(), "cc-large")
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (large.join(least, [*keys, "u"]).where(v != F.col("m"))
                 .select(*keys, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(least.select(*keys, "u", F.col("m").alias("v"))).where(u != v).distinct())
        new = stage(small, "cc-small")
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)"))).first())
        drop_staged(spark, now, large)
        now = new
        if mark == before:
            break
        before = mark
    stars = now.select(*keys, u.alias("id"), v.alias("_root"))
    return nodes.select(*keys, "id").join(stars, [*keys, "id"], "left").select(
        *keys, "id", F.coalesce("_root", "id").alias("label"))


def number_rows(df: DataFrame, order: list, out_col: str, keys=()) -> DataFrame:
    """``df`` plus its 0-based rank by ``order``: inside each key, or over the whole table. The whole table
    is range-partitioned and each range numbered from the counts of the ranges before it, so no task sorts
    more than one range."""
    keys = list(keys)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out_col, (F.row_number().over(w) - 1).cast("int"))
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))     # one row per range
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_from"))
    return (ranged.withColumn("_p", part).join(starts, "_p")
            .withColumn(out_col, (F.col("_from") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("int"))
            .drop("_id", "_p", "_from"))


def density_cluster(df: DataFrame, eps: float | None = None, min_cluster_size: int = 2,
                    min_samples: int = 1, id_col: str = "vec_id", vec_col: str = "vec", keys=(),
                    block_size: int = 1024) -> DataFrame:
    """M3: density labels per group, ``-1`` = noise.

    Distance is cosine distance ``1 - cos``. Core distance = distance to the ``min_samples``-th nearest other
    row; edge weight = ``greatest(core_a, core_b, d)`` (mutual reachability). Without ``eps`` the clusters are
    those of the density hierarchy that live longest (``hierarchy``). With ``eps`` the hierarchy is cut there: edges
    with weight <= ``eps`` join rows, and components smaller than ``min_cluster_size`` are noise. Only edges of
    spanning trees of block pairs are written, never all near pairs: they join the same rows at any ``eps``.

    A group with fewer rows than ``min_cluster_size`` is all noise, and so are rows without a usable vector (see
    ``usable_vectors``); a row with a null id gets -1. Clusters are numbered from 0 by size desc, then smallest
    id. Output: keys, ``id_col``, ``cluster_id``, one row per input row."""
    keys = list(keys)
    group = keys or ["_g"]      # without keys the whole table is one group
    rows = df if keys else df.withColumn("_g", F.lit(0))
    if eps is None:
        labels = stage(hierarchical_labels(rows, min_cluster_size, min_samples, id_col, vec_col, group, block_size), "labels")
    else:
        core = core_distances(rows, min_samples, id_col, vec_col, group, block_size)
        # a row with fewer than min_samples others has no core distance and joins nobody
        core = core if core is None else core.withColumn("core", F.coalesce("core", F.lit(float("inf"))))
        edges = spanning_edges(rows, core, id_col, vec_col, group, block_size).where(F.col("w") <= round(eps, 12))
        ids = usable_vectors(rows, id_col, vec_col, group).select(*group, F.col(id_col).alias("id"))
        labels = stage(connected_components(ids, edges.select(*group, F.col("u").alias("src"), F.col("v").alias("dst")), group), "labels")
    return _numbered(rows, labels, min_cluster_size, id_col, keys, group)


def _numbered(rows: DataFrame, labels: DataFrame, min_cluster_size: int, id_col: str, keys: list[str], group: list[str]) -> DataFrame:
    """``labels`` (group, ``id``, ``label``) as cluster numbers, one row for each of ``rows``."""
    sizes = labels.where(F.col("label").isNotNull()).groupBy(*group, "label").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    kept = sizes.where(F.col("size") >= min_cluster_size)
    numbered = number_rows(kept, [F.col("size").desc(), F.col("first")], "cluster_id", keys)
    found = labels.join(numbered.select(*group, "label", "cluster_id"), [*group, "label"]).select(
        *group, F.col("id").alias(id_col), "cluster_id")
    return (rows.select(*group, id_col).join(found, [*group, id_col], "left")
                .select(*keys, id_col, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")))


def density_cluster_windows(df: DataFrame, span: int, first: int, last: int, eps: float | None = None,
                            min_cluster_size: int = 2, id_col: str = "vec_id", vec_col: str = "vec", step_col: str = "step",
                            keys=("product_id",), wanted: DataFrame | None = None, block_size: int = 1024) -> DataFrame:
    """M3 (with one sample) for many overlapping windows: window ``t`` holds the rows of steps ``t - span + 1`` to
    ``t``, for ``t`` from ``first`` to ``last``; ``wanted`` (keys, ``window``) keeps some of them.

    Vectors are compared once, whatever number of windows holds them (``windowed_spanning_edges``); windows get
    copies of ids and of tree edges only. Each window's labels are those of ``density_cluster`` on its rows; where
    pairs of different blocks have equal weights, the hierarchy may take them in another order. Ids are unique in a
    group (D1): of a repeated one, one row is compared. Output: keys, ``window``, ``id_col``, ``cluster_id``, one row
    per row and window; rows without a usable vector or id are noise."""
    keys = list(keys)
    own = [*keys, "window"]

    def dealt(rows: DataFrame, lo: str, hi: str) -> DataFrame:
        windows = F.sequence(F.greatest(F.col(hi), F.lit(first)), F.least(F.col(lo) + span - 1, F.lit(last)))
        out = rows.withColumn("window", F.explode(windows))
        return out if wanted is None else out.join(checked_broadcast(wanted.select(*own).distinct()), own, "left_semi")

    rows = df.where(F.col(step_col).between(first - span + 1, last)).withColumn(step_col, F.col(step_col).cast("long"))
    usable = stage(usable_vectors(rows.select(*keys, id_col, vec_col, step_col), id_col, vec_col, keys), "vectors")
    shared = stage(windowed_spanning_edges(usable, span, step_col, id_col, vec_col, keys, block_size), "shared-edges")
    edges = dealt(shared, "lo", "hi").select(*own, "u", "v", "w")
    ids = dealt(usable, step_col, step_col).select(*own, F.col(id_col).alias("id"))
    if eps is None:
        labels = labels_of_edges(stage(ids, "window-ids"), stage(edges, "window-edges"), min_cluster_size, own)
    else:
        near = edges.where(F.col("w") <= round(eps, 12))
        labels = connected_components(ids, near.select(*own, F.col("u").alias("src"), F.col("v").alias("dst")), own)
    return _numbered(dealt(rows, step_col, step_col), stage(labels, "labels"), min_cluster_size, id_col, own, own)


def _mean_vector(vec_col: str) -> Column:
    """Aggregate: the mean of a group's vectors as an array, rounded to nine digits so that it does not depend
    on the order of addition. Every task adds up its own vectors; no row per component is made."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec_col))))
    return F.transform(mean, lambda x: F.round(x, 9))


def _squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def kmeans_fallback(clustered: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "vec", keys=(),
                    max_rounds: int = 100) -> DataFrame:
    """M4: keys where every row is noise get ``k`` k-means clusters; other keys keep their labels.

    The first centres of a key are the ``k`` rows with the smallest hashes of their ids, so the result does
    not depend on partitioning; means are rounded to nine digits for the same reason. A round is a join with
    one row per key (its k centres), a row-wise nearest centre and a grouped mean. Rounds end when no centre
    of any key changes, and keys that are done take no part in later rounds; if some still move after
    ``max_rounds``, a warning says how many. Rows without a usable vector stay noise."""
    keys = list(keys)
    group = [*keys, "_g"]       # without keys the whole table is one group
    rows = clustered.withColumn("_g", F.lit(0))
    empty = rows.groupBy(*group).agg(F.max("cluster_id").alias("_top")).where(F.col("_top") == -1).select(*group)
    noise = usable_vectors(rows.join(empty, group, "left_semi"), id_col, vec_col, group)
    noise = stage(noise.select(*group, F.col(id_col), F.col(vec_col)), "noise")
    rank = Window.partitionBy(*group).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    first = noise.withColumn("_c", F.row_number().over(rank)).where(F.col("_c") <= k)
    centres = stage(first.groupBy(*group).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_c", F.col(vec_col).alias("x")))), lambda s: s["x"]).alias("_centres"))
        .withColumn("_moved", F.lit(True)), "centres")

    def nearest(c: DataFrame) -> DataFrame:
        near = F.array_min(F.transform("_centres", lambda m, i: F.struct(_squared_distance(m, F.col(vec_col)).alias("d"), i.alias("i"))))
        return noise.join(c, group).withColumn("_near", near["i"])

    done, moving = None, centres
    for _ in range(max_rounds):
        means = nearest(moving).groupBy(*group, "_near").agg(_mean_vector(vec_col).alias("_v"))
        new = means.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_near", "_v"))).alias("_new"))
        # a centre that no row is nearest to stays where it is
        at = F.transform("_centres", lambda m, i: F.coalesce(F.filter("_new", lambda x: x["_near"] == i)[0]["_v"], m))
        moved = stage(moving.join(new, group).select(*group, at.alias("_centres"), (at != F.col("_centres")).alias("_moved")), "centres")
        still = moved.where(~F.col("_moved"))
        done = still if done is None else done.unionByName(still)
        moving = moved.where("_moved")
        if moving.isEmpty():
            break
    else:
        warnings.warn(f"k-means: centres of {moving.count()} keys still move after {max_rounds} rounds")
    centres = centres.limit(0) if done is None else done
    labels = nearest(centres.unionByName(moving)).select(*group, F.col(id_col), F.col("_near").alias("_label"))
    return (rows.join(labels, [*group, id_col], "left")
            .withColumn("cluster_id", F.coalesce("_label", "cluster_id").cast("int")).drop("_label", "_g"))


def keyword_fallback(clustered: DataFrame, keys=KEYS, groups=C.DEFAULT_KEYWORD_GROUPS,
                     text_col: str = "content") -> DataFrame:
    """M5: keys with fewer than two non-noise clusters (A8) regroup *all* their reviews by the
    keyword cascade (S8); empty groups never appear since groups are formed from rows."""
    flags = needs_fallback(clustered, keys).select(*keys, "needs_fallback")
    # one row per key: broadcast after a size check, so the review text is not shuffled to meet it
    j = clustered.join(checked_broadcast(flags), list(keys))
    return j.withColumn("cluster_id", F.when(F.col("needs_fallback"), keyword_group(text_col, groups))
                        .otherwise(F.col("cluster_id"))).drop("needs_fallback")


def centroids(df: DataFrame, group=("cluster_id",), vec_col: str = "vec") -> DataFrame:
    """Mean vector per group: every task adds up its vectors, one sum a group and task is shuffled."""
    return df.groupBy(*group).agg(_mean_vector(vec_col).alias("centroid"))


def _members(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """The rows of clusters that have a usable vector."""
    row = F.monotonically_increasing_id()
    return usable_vectors(df.where(F.col(group) != -1).withColumn("_row", row), "_row", vec_col, unique=True).drop("_row")


def merge_similar_clusters(df: DataFrame, threshold: float, group: str = "cluster_id",
                           vec_col: str = "vec", keys=()) -> DataFrame:
    """M6: clusters whose centroids have cosine >= ``threshold`` are one issue; each cluster maps
    to the smallest id of its connected group. Output: keys, ``cluster_id``, ``merged_id``. Rows without a usable
    vector do not count; a cluster of such rows only is left out."""
    keys = list(keys)
    cents = centroids(_members(df, group, vec_col), [*keys, group], vec_col)
    pairs = similar_pairs(cents, threshold, group, "centroid", keys)
    nodes = cents.select(*keys, F.col(group).alias("id"))
    edges = pairs.select(*keys, F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    labels = connected_components(nodes, edges, keys)
    return labels.select(*keys, F.col("id").alias(group), F.col("label").alias("merged_id"))


def cluster_representatives(df: DataFrame, n: int, group: str = "cluster_id", id_col: str = "vec_id",
                            vec_col: str = "vec", keys=()) -> DataFrame:
    """M7: the ``n`` members nearest their cluster centroid (cosine), ties by id. Rows without a usable vector are
    no representatives."""
    keys = list(keys)
    members = _members(df, group, vec_col)
    j = members.join(centroids(members, [*keys, group], vec_col), [*keys, group])
    dot = F.aggregate(F.zip_with(vec_col, "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(F.transform(vec_col, lambda a: a * a), F.lit(0.0), lambda s, x: s + x))
    nb = F.sqrt(F.aggregate(F.transform("centroid", lambda a: a * a), F.lit(0.0), lambda s, x: s + x))
    scored = j.withColumn("cosine", dot / (na * nb))
    w = Window.partitionBy(*keys, group).orderBy(F.col("cosine").desc(), F.col(id_col))
    return (scored.withColumn("rep_rank", F.row_number().over(w)).where(F.col("rep_rank") <= n)
                  .select(*keys, group, id_col, "rep_rank", "cosine"))
