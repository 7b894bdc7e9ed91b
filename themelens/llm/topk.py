"""Exact top-k inner product search with norm order, SVD rotation and Cauchy-Schwarz bounds.

* Components become ``floor(256 * x)``, so scores are integers and exact.
* The rotation comes from the Gram matrix (dimension x dimension, summed in tasks): in its eigenbasis the
  first coordinates carry most of a vector's length, so partial sums are tight early.
* Candidates are range-partitioned by length, longest first (ties by id, so equal vectors spread). Each task
  goes through its candidates in that order, in blocks. For a query q with current k-th score t, a block is
  left out when its longest vector times |q| is below t; otherwise partial inner products over the first
  rotated coordinates plus |rest of q| * |rest of x| bound each score, and only pairs whose bound reaches t
  are multiplied out exactly. The longest ``SEEDS`` vectors give every query a first t.
* Each task returns its own k best per query; a grouped window merges them.

Queries are the rows that the caller names, staged once. They are taken in blocks of ``QUERY_BLOCK`` rows, one
pass over the candidates per block, whose broadcast is released when the block's results are written, so what is
broadcast has a fixed bound however many queries there are. Scores of
pairs are never written, only k per query and task.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows with
a null id. Shorter vectors are padded with zeros. Own rows are recognised by id, so rows that repeat an id
are never their own candidates; a repeated query id is one query (the first of its equal-id rows by vector).
Ties go to the smaller id. With fewer candidates than k all are returned. Ids are whole numbers (another type is
an error). Partial sums are whole numbers of at most |q| |x|, exact below 2 ** 53; if the longest query and the
longest vector exceed that, the search fails before it starts rather than return wrong scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from themelens.session import stage

K = 5
SCALE = 256
QUERY_BLOCK = 4096
SEEDS = 1024                # longest vectors that give the first bounds
BLOCK = 2048                # candidates multiplied at a time
HEAD = 0.25                 # share of the rotated coordinates in the partial sum
ROWS_PER_PART = 50_000


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v, norm)``: integer-valued vectors of the rows that take part."""
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(
        F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    out = rows.where(ok).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))


def _matrix(vectors: pd.Series | list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal basis of the vectors by falling singular value (from the summed Gram matrix)."""
    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for rows in batches:
            m = _matrix(rows["v"], dim)
            total += m.T @ m
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    cells = vectors.select("v").mapInPandas(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    g = np.zeros((dim, dim))
    for r in cells.collect():       # dim * dim cells
        g[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy()


def _merge_best(score, ids, new_score, new_ids, k):
    """The k best per row of old and new candidates: by falling score, then smaller id."""
    s, i = np.concatenate([score, new_score], axis=1), np.concatenate([ids, new_ids], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _exact(q, q_ids, x, x_ids, k):
    """Scores of all rows of ``x`` for each query, cut to those that may be among the k best."""
    s = q @ x.T
    s[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if s.shape[1] > 4 * k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        n = int((s >= least).sum(axis=1).max())     # ties with the k-th score stay in
        part = np.argsort(-s, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(s, part, 1), x_ids[part]
    return s, np.broadcast_to(x_ids, s.shape).copy()


def _search(shared, dim: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q, basis, seed_scores = shared.value
        head = max(1, int(dim * HEAD))
        qr = q @ basis
        q_norm = np.linalg.norm(q, axis=1)
        q_head, q_rest = qr[:, :head], np.linalg.norm(qr[:, head:], axis=1)
        score = np.full((len(q), k), -np.inf)
        ids = np.full((len(q), k), np.iinfo(np.int64).max)
        slack = 1e-9 * q_norm       # for rounding in the rotated sums
        for rows in batches:        # sorted by falling length
            for a in range(0, len(rows), BLOCK):
                part = rows.iloc[a:a + BLOCK]
                x, x_ids, norm = _matrix(part["v"], dim), part["vec_id"].to_numpy(), part["norm"].to_numpy()
                bound = np.maximum(score[:, -1], seed_scores)
                open_q = np.flatnonzero(q_norm * norm.max() * (1 + 1e-9) >= bound)
                if not len(open_q):
                    continue
                xr = x @ basis
                x_rest = np.linalg.norm(xr[:, head:], axis=1)
                upper = q_head[open_q] @ xr[:, :head].T + q_rest[open_q, None] * x_rest[None, :]
                live = upper + slack[open_q, None] * norm[None, :] + 1e-6 >= bound[open_q, None]
                some, cand = live.any(axis=1), np.flatnonzero(live.any(axis=0))
                if not len(cand):
                    continue
                rows_q = open_q[some]
                s, i = _exact(q[rows_q], q_ids[rows_q], x[cand], x_ids[cand], k)
                score[rows_q], ids[rows_q] = _merge_best(score[rows_q], ids[rows_q], s, i, k)
        at = np.argwhere(score > -np.inf)
        yield pd.DataFrame({"query_id": q_ids[at[:, 0]], "vec_id": ids[at[:, 0], at[:, 1]],
                            "score": score[at[:, 0], at[:, 1]].astype(np.int64)})

    return run


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows for each row where ``is_query`` holds."""
    spark = rows.sparkSession
    if rows.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold whole numbers")
    vectors = stage(clean_vectors(rows, id_col, vector_col), "vectors")
    n, dim, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    dim = max(1, dim or 0)
    basis = rotation(vectors, dim)
    parts = max(1, -(-n // ROWS_PER_PART), int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_norm = vectors.repartitionByRange(parts, F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    ordered = stage(by_norm, "by-norm")
    seeds = vectors.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).toPandas()       # SEEDS rows
    seed, seed_ids = _matrix(seeds["v"], dim), seeds["vec_id"].to_numpy(np.int64)
    queries = stage(vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.*"), "queries")
    n_q, longest_q = queries.agg(F.count("*"), F.max("norm")).first()
    if (longest_q or 0.0) * (longest or 0.0) >= 2.0 ** 53:
        raise ValueError(f"scores up to {longest_q * longest:.3g} exceed 2 ** 53 and would not be exact")
    blocks = -(-n_q // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        block = part.select("vec_id", "v").toPandas()                                                     # about QUERY_BLOCK rows
        q, q_ids = _matrix(block["v"], dim), block["vec_id"].to_numpy(np.int64)
        first = q @ seed.T
        first[q_ids[:, None] == seed_ids[None, :]] = -np.inf
        kth = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(q), -np.inf)
        shared = spark.sparkContext.broadcast((q_ids, q, basis, kth))
        one = stage(ordered.mapInPandas(_search(shared, dim, k), "query_id long, vec_id long, score long"), "best")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Win.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
