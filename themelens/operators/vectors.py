"""Vectors (M1, M2, J7, U1).

J7 is an exact cosine self-join inside a group without emitting all pairs as rows: each group is cut
into blocks of near vectors, a block pair ``(lo, hi)`` becomes one ``applyInPandas`` group (so a task holds
two blocks, however hot the group), and a NumPy matrix product per block pair emits only the pairs that
qualify (threshold) or each row's best ``k`` (kNN, merged afterwards by a group-limited window). Every row
goes to as many block pairs as there are blocks, so ``block_size`` is the least size of a block: blocks grow
with the group, up to a limit that keeps a task small (``rows_a_block``). Blocks gather around pivots, and
a block pair whose angle bound shows that it holds nothing is skipped. Tables whose groups have at most
``PRUNE_FROM`` times ``block_size`` rows are cut by hash and compared whole, which is cheaper than placing them first.
Copies of rows are shuffled in rounds of a bounded number (``_rounds``), each written before the next begins, so disk
grows with the rows and not with the block pairs. Vectors that lose nothing by it are copied as ``array<float>``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, PCA, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelens.functions.text import flatten_newlines, tokens
from themelens.session import drop_staged, stage

DEFAULT_BLOCK = 1024
MAX_PIVOTS = 256            # vectors that the driver and every task hold to bound angles
SAMPLE_PER_PIVOT = 16
PRUNE_FROM = 16             # least blocks of the largest group beyond which block pairs are bounded first
BLOCKS, LARGE_BLOCK = 32, 16_384            # blocks of a group, until they reach so many rows: products of vectors
TREE_BLOCKS, LARGE_TREE_BLOCK = 8, 16_384   # the same for spanning edges
TREE_PART = 2048            # rows of a block whose distances to as many of another one a task holds at a time
STRIP = 1 << 23             # products of vectors that a task holds at a time
IN_FLIGHT = 1 << 20         # copies of rows that are shuffled at a time, or two of every row
THIN_FROM = 8               # spanning edges a row that are kept between rounds before they are thinned


# ------------------------------------------------------------------------------------------------
# M1, U1, M2
# ------------------------------------------------------------------------------------------------
def embed_texts(df: DataFrame, text_col: str = "content", out_col: str = "vec",
                num_features: int = 1024, seed_model=None) -> DataFrame:
    """M1: text -> unit vector with Spark ML (token hashing, IDF weights, L2 normalisation).
    Newlines are flattened first (F3). Returns ``out_col`` as ``array<double>``."""
    t = df.withColumn("_toks", tokens(flatten_newlines(text_col)))
    tf = HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=num_features).transform(t)
    idf = seed_model or IDF(inputCol="_tf", outputCol="_tfidf").fit(tf)
    v = Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0).transform(idf.transform(tf))
    return v.withColumn(out_col, vector_to_array("_vec")).drop("_toks", "_tf", "_tfidf", "_vec")


def _hashed(df: DataFrame, text_col: str, num_features: int) -> DataFrame:
    """``df`` with the token counts ``_tf`` of each text, a sparse vector of hashed tokens."""
    t = df.withColumn("_toks", F.coalesce(tokens(flatten_newlines(text_col)), F.array().cast("array<string>")))
    return HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=num_features).transform(t).drop("_toks")


def document_counts(df: DataFrame, text_col: str = "content", keys=("iso_week",), num_features: int = 1024) -> DataFrame:
    """For M1: per key the number of texts ``n_docs`` and of those that hold each hashed token (``counts``, an
    array of ``num_features``). Counts add up over keys, so a run counts its own weeks only and the stored
    table (``sources.tables.write_document_counts``) keeps the rest. A null text is a text without tokens."""
    seen = Summarizer.metrics("count", "numNonZeros").summary(F.col("_tf")).alias("s")
    return _hashed(df, text_col, num_features).groupBy(*keys).agg(seen).select(
        *keys, F.col("s.count").alias("n_docs"), vector_to_array("s.numNonZeros").cast("array<long>").alias("counts"))


def embed_with_counts(df: DataFrame, counts: DataFrame, version: str, text_col: str = "content", out_col: str = "vec",
                      week_col: str = "iso_week", dense: bool = False) -> DataFrame:
    """M1 with stored document counts: a text's vector depends on the text and on ``version`` alone, the last week
    whose counts are used, so vectors of one version are comparable whichever run made them.

    Weights are ``ln((1 + n) / (1 + count)) + 1``; vectors have length 1 (0 for a text without tokens). ``out_col``
    is a sparse vector, or ``array<double>`` if ``dense``; ``vec_version`` names the version. The driver holds one
    number per feature. A version without counts, or counts of different lengths, is an error."""
    known = counts.where(F.col(week_col) <= version)
    sums = known.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"), F.count("*").alias("weeks"))
    cells = sorted(tuple(r) for r in sums.collect())        # num_features rows
    if not cells:
        raise ValueError(f"no document counts up to {version}")
    if len({weeks for *_, weeks in cells}) > 1:
        raise ValueError("document counts of different numbers of features cannot be added")
    n = known.agg(F.sum("n_docs")).first()[0]
    weights = Vectors.dense(np.log((1 + n) / (1 + np.array([c for _, c, _ in cells]))) + 1)
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol="_tfidf").transform(_hashed(df, text_col, len(cells)))
    v = Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0).transform(weighted)
    out = vector_to_array("_vec") if dense else F.col("_vec")
    return v.withColumns({out_col: out, "vec_version": F.lit(version)}).drop("_tf", "_tfidf", "_vec")


def embed_with(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]],
               text_col: str = "content", out_col: str = "vec", batch_size: int = 50) -> DataFrame:
    """User embedding function on batches of texts (Arrow batches via ``mapInPandas``).

    A batch whose result has the wrong length fails the task (and Spark retries it) rather than
    silently emptying the result."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                texts = [("" if t is None else str(t)).replace("\n", " ") for t in part[text_col]]
                vecs = embedder(texts)
                if len(vecs) != len(texts):
                    raise ValueError(f"embedder returned {len(vecs)} vectors for {len(texts)} texts")
                part[out_col] = [list(map(float, v)) for v in vecs]
                yield part

    return df.mapInPandas(run, schema)


def reduce_dims(df: DataFrame, k: int = 5, vec_col: str = "vec", out_col: str = "vec_k") -> DataFrame:
    """M2: project to ``k`` dimensions with Spark ML PCA (a linear stand-in for the reference's
    non-linear reduction; fitted distributedly, the model is a d x k matrix). An empty table stays empty."""
    if df.isEmpty():
        return df.withColumn(out_col, F.col(vec_col))
    v = df.withColumn("_v", array_to_vector(vec_col))
    model = PCA(k=k, inputCol="_v", outputCol="_pk").fit(v)
    return model.transform(v).withColumn(out_col, vector_to_array("_pk")).drop("_v", "_pk")


# ------------------------------------------------------------------------------------------------
# J7
# ------------------------------------------------------------------------------------------------
def rows_a_block(n: int, block_size: int, blocks: int = BLOCKS, largest: int = LARGE_BLOCK) -> int:
    """Rows of a block of a group of ``n``: about ``blocks`` blocks, none below ``block_size`` or, if that is less,
    above ``largest``. Rows are copied once a block, so few blocks keep the copies few."""
    return max(1, block_size, min(-(-n // blocks), largest))


def _placed(df: DataFrame, keys: list[str], id_col: str, vec_col: str, block_size: int,
            blocks: int = BLOCKS, largest: int = LARGE_BLOCK, also=()) -> DataFrame:
    """keys, ``_id``, ``_v``, ``also``, and each row's block ``_b`` of the ``_nb`` of its group, by the hash of the id."""
    base = df.select(*keys, F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), *also)
    if keys == ["_g"]:
        # one group (the whole table): its block count is one scalar, no join needed
        n = df.count()
        base = base.withColumn("_nb", F.lit(max(1, -(-n // rows_a_block(n, block_size, blocks, largest)))))
    else:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        size = F.greatest(F.lit(max(1, block_size)), F.least(F.ceil(F.col("_n") / F.lit(blocks)), F.lit(largest)))
        nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / size)).cast("int")
        base = base.join(counts.withColumn("_nb", nb).drop("_n"), keys)
    return base.withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))


def _rounds(n: int, blocks: int, first: int) -> list[tuple[int, int]]:
    """The distances ``first`` to half the number of blocks, in ranges that copy ``n`` rows a bounded number of times.
    A group's blocks lie on a ring: a block has two partners at each distance, and itself at 0."""
    size = max(2, IN_FLIGHT // max(1, n)) // 2
    return [(at, min(at + size - 1, blocks // 2)) for at in range(first, blocks // 2 + 1, size)]


def _ring_distance(a, b, blocks) -> Column:
    return F.least(F.pmod(a - b, blocks), F.pmod(b - a, blocks))


def _paired(placed: DataFrame, keys: list[str], also=(), first: int = 0, last: int | None = None) -> DataFrame:
    """Every row in the block pairs it belongs to: (min(b, j), max(b, j)) for all blocks j, or those whose distance
    on the ring is from ``first`` to ``last``."""
    others = F.sequence(F.lit(0), F.col("_nb") - 1)
    if last is not None:
        others = F.filter(others, lambda j: _ring_distance(j, F.col("_b"), F.col("_nb")).between(first, last))
    rep = placed.withColumn("_j", F.explode(others))
    return rep.select(*keys, "_id", "_v", *also, "_b",
                      F.least("_b", "_j").alias("_lo"), F.greatest("_b", "_j").alias("_hi"))


def _blocked(df: DataFrame, keys: list[str], id_col: str, vec_col: str, block_size: int) -> DataFrame:
    return _paired(_placed(df, keys, id_col, vec_col, block_size), keys)


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", keys=(), unique: bool = False) -> DataFrame:
    """The rows that can be compared: id not null, a vector of finite numbers with the most common length of
    the table (the longer one on a tie), and for a repeated id of a key one row (ids are known to be ``unique``:
    not looked for). Other rows have no neighbours."""
    sizes = df.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    size = sizes.agg(F.max(F.struct("_n", "_s")).alias("m")).first()["m"]
    if size is None:
        return df.limit(0)
    x = F.col(vec_col)
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(x) == size["_s"]) & finite)
    return rows if unique else rows.dropDuplicates([*keys, id_col])


def narrow_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with its vectors as ``array<float>`` if that changes no number: half the bytes where rows are copied."""
    x = F.col(vec_col)
    if df.schema[vec_col].dataType.simpleString() != "array<double>":
        return df
    narrow = x.cast("array<float>")
    exact = df.agg(F.bool_and(narrow.cast("array<double>") == x)).first()[0]
    return df.withColumn(vec_col, narrow) if exact else df


def _strips(n: int, width: int) -> list[slice]:
    """The rows of ``n`` in strips of at most about ``STRIP`` cells."""
    size = max(1, STRIP // max(1, width))
    return [slice(at, min(n, at + size)) for at in range(0, n, size)]


def _best(row: np.ndarray, col: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's ``k`` largest cosines, ties by the smaller column."""
    order = np.lexsort((col, -cosine, row))
    row = row[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return order[rank < k]


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return mat / n


def _largest(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).agg(F.max("_size")).first()[0] or 0


def _cut(df: DataFrame, keys: list[str], id_col: str, vec_col: str, block_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows cut into blocks of near vectors: (keys, ``_id``, ``_v``, ``_b``), the blocks (keys, ``_b``, ``_cell``,
    ``_radius``, ``_n``) and the angles between pivots.

    Pivots are at most ``MAX_PIVOTS`` vectors, far apart from each other, of a sample by the hash of the ids
    (``SAMPLE_PER_PIVOT`` each) of groups with several blocks; they only decide what can be skipped. A row belongs
    to its nearest pivot's cell, and a cell with too many rows is cut by the hash of the id."""
    rows = df.select(*keys, F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    largest = _largest(rows, keys)
    if keys == ["_g"]:          # one group: its size is one scalar, no join needed
        rows = rows.withColumn("_size", F.lit(largest))
    else:
        rows = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), keys)
    rows = stage(rows, "vectors")
    several = F.col("_size") > block_size
    n_pivots = min(MAX_PIVOTS, -(-largest * 5 // (block_size * 4)))
    sample = rows.where(several).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(SAMPLE_PER_PIVOT * n_pivots)
    pivots = _far_apart(_unit(np.array([r["_v"] for r in sample.select("_v").collect()], np.float64)), n_pivots)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest_pivot(vectors: pd.Series) -> pd.DataFrame:
        angle = np.arccos(np.clip(_unit(np.vstack(vectors.to_numpy()).astype(np.float64)) @ pivots.T, -1, 1))
        cell = angle.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle[np.arange(len(cell)), cell]})

    placed = rows.where(several).withColumn("_p", nearest_pivot("_v")).select(*keys, "_id", "_v", F.col("_p.cell").alias("_cell"), F.col("_p.angle").alias("_angle"))
    placed = stage(placed.unionByName(rows.where(~several).select(*keys, "_id", "_v", F.lit(0).alias("_cell"), F.lit(0.0).alias("_angle"))), "cells")
    drop_staged(df.sparkSession, rows)
    parts = placed.groupBy(*keys, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_size)).alias("_parts"))
    if keys == ["_g"]:
        parts = F.broadcast(parts)      # a row for each pivot
    number = F.col("_cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("_id"), F.col("_parts"))
    placed = placed.join(parts, [*keys, "_cell"]).withColumn("_b", number)
    blocks = stage(placed.groupBy(*keys, "_b").agg(F.first("_cell").alias("_cell"), F.max("_angle").alias("_radius"),
                                                   F.count(F.lit(1)).alias("_n")), "blocks")
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    k = len(pivots)
    angles = df.sparkSession.createDataFrame(pd.DataFrame({
        "_ca": np.repeat(np.arange(k, dtype=np.int32), k), "_cb": np.tile(np.arange(k, dtype=np.int32), k), "_between": between.ravel()}))
    return placed.select(*keys, "_id", "_v", "_b"), blocks, angles


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of unit vectors: each the one farthest from those before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def block_pairs(blocks: DataFrame, angles: DataFrame, keys) -> DataFrame:
    """Pairs of blocks of a group, ``_lo`` <= ``_hi``, with ``_gap``: no vector of one is at a smaller angle to one of
    the other (the angle is a metric: pivots' angle less both radii). One row per block and partner, not per row."""
    keys = list(keys)
    side = lambda a, b: blocks.select(*keys, F.col("_b").alias(a), *[F.col(c).alias(c + b) for c in blocks.columns if c not in (*keys, "_b", "_cell")],
                                      F.col("_cell").alias(f"_c{b}"))
    pairs = side("_lo", "a").join(side("_hi", "b"), keys).where(F.col("_lo") <= F.col("_hi"))
    gap = F.greatest(F.lit(0.0), F.col("_between") - F.col("_radiusa") - F.col("_radiusb") - 1e-7)
    return pairs.join(F.broadcast(angles), ["_ca", "_cb"]).withColumn("_gap", gap)


def _dealt(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once for every pair that its block is in."""
    both = pairs.select(*keys, "_lo", "_hi", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_b"))
    return rows.join(both, [*keys, "_b"]).select(*rows.columns, "_lo", "_hi")


def similar_pairs(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "vec",
                  keys=(), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """J7 (threshold): all pairs ``id_a < id_b`` in the same group with cosine >= ``threshold``. Exact: pairs of
    blocks are skipped only if their ``_gap`` exceeds the threshold's angle. Output: keys, ``id_a``, ``id_b``,
    ``cosine``. Rows that ``usable_vectors`` leaves out have no pairs."""
    keys = list(keys)
    if not keys:
        return similar_pairs(df.withColumn("_g", F.lit(0)), threshold, id_col, vec_col, ["_g"],
                             block_size).drop("_g")
    usable = usable_vectors(df, id_col, vec_col, keys)
    largest = _largest(usable, keys)
    if largest <= PRUNE_FROM * block_size:
        rep = _blocked(usable, keys, id_col, vec_col, block_size)
    else:
        rows, blocks, angles = _cut(usable, keys, id_col, vec_col, rows_a_block(largest, block_size))
        reach = float(np.arccos(np.clip(threshold, -1, 1)))
        near = block_pairs(blocks, angles, keys).where((F.col("_lo") == F.col("_hi")) | (F.col("_gap") <= reach))
        rep = _dealt(rows, near, keys)
    id_type = df.schema[id_col].dataType
    out = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("id_a", id_type), T.StructField("id_b", id_type),
        T.StructField("cosine", T.DoubleType())])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        a = pdf[pdf["_b"] == lo]
        b = a if lo == hi else pdf[pdf["_b"] == hi]
        if a.empty or b.empty:
            return pd.DataFrame(columns=out.names)
        xa = _unit(np.vstack(a["_v"].to_numpy()).astype(np.float64))
        xb = xa if lo == hi else _unit(np.vstack(b["_v"].to_numpy()).astype(np.float64))
        found = []
        for strip in _strips(len(xa), len(xb)):
            sim = xa[strip] @ xb.T
            at, ib = np.nonzero(sim >= threshold)
            found.append((at + strip.start, ib, sim[at, ib]))
        ia, ib, s = (np.concatenate(x) for x in zip(*found))
        ida, idb = a["_id"].to_numpy()[ia], b["_id"].to_numpy()[ib]
        keep = ida < idb if lo == hi else ida != idb
        ida, idb, s = ida[keep], idb[keep], s[keep]
        first, second = np.minimum(ida, idb), np.maximum(ida, idb)
        res = pd.DataFrame({"id_a": first, "id_b": second, "cosine": s})
        for k in keys:
            res.insert(len(res.columns) - 3, k, pdf[k].iloc[0])
        return res[out.names]

    return rep.groupBy(*keys, "_lo", "_hi").applyInPandas(pairs, out)


def nearest_neighbours(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "vec",
                       keys=(), block_size: int = DEFAULT_BLOCK, unique: bool = False) -> DataFrame:
    """J7 (kNN): each row's ``k`` most similar *other* rows in its group (ties by neighbour id).

    First every block by itself, which bounds the cosine of each row's k-th neighbour; then the pairs of blocks,
    of which only cosines that reach the bound of one of the two rows are looked at, so the result is exact.
    Pairs of blocks whose ``_gap`` is beyond both blocks' bounds are skipped. Each block pair emits at
    most ``k`` candidates per row; a group-limited ``row_number`` merges them, after every round of block pairs if
    there are several. Output: keys, ``id``, ``nbr``, ``cosine``, ``nn_rank``. Rows that ``usable_vectors`` leaves
    out have no neighbours and are nobody's; ids may be known to be ``unique``."""
    keys = list(keys)
    if not keys:
        return nearest_neighbours(df.withColumn("_g", F.lit(0)), k, id_col, vec_col, ["_g"],
                                  block_size, unique).drop("_g")
    id_type = df.schema[id_col].dataType
    out = T.StructType([df.schema[c] for c in keys] + [T.StructField("_b", T.LongType()),
        T.StructField("id", id_type), T.StructField("nbr", id_type), T.StructField("cosine", T.DoubleType())])

    def made(pdf: pd.DataFrame, parts: list[tuple]) -> pd.DataFrame:
        res = pd.concat([pd.DataFrame({"_b": side["_b"].iloc[0], "id": side["_id"].to_numpy()[i], "nbr": other["_id"].to_numpy()[j], "cosine": s})
                         for side, other, i, j, s in parts])
        for c in keys:
            res.insert(len(res.columns) - 4, c, pdf[c].iloc[0])
        return res[out.names]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_id")              # columns in the order of the ids, for ties
        xa, kk = _unit(np.vstack(x["_v"].to_numpy()).astype(np.float64)), min(k, len(x) - 1)
        found = []
        for strip in _strips(len(xa), len(xa)) if kk > 0 else []:
            sim = xa[strip] @ xa.T
            own = np.arange(strip.start, strip.stop)
            sim[own - strip.start, own] = -np.inf       # never yourself
            least = np.partition(sim, -kk, axis=1)[:, -kk]
            i, j = np.nonzero(sim >= least[:, None])
            s = sim[i, j]
            best = _best(i, j, s, kk)
            found.append((i[best] + strip.start, j[best], s[best]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return made(pdf, [(x, x, *(found and (np.concatenate(c) for c in zip(*found)) or none))])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["_b"] == pdf[side].iloc[0]].sort_values("_id") for side in ("_lo", "_hi"))
        if x.empty or y.empty:
            return pd.DataFrame(columns=out.names)
        xa, ya = (_unit(np.vstack(z["_v"].to_numpy()).astype(np.float64)) for z in (x, y))
        bx, by = x["_bound"].to_numpy(), y["_bound"].to_numpy()
        rows, cols = [], []                     # candidates of x and of y
        for strip in _strips(len(xa), len(ya)):
            sim = xa[strip] @ ya.T
            for reach, found, axis in ((bx[strip, None], rows, 0), (by[None, :], cols, 1)):
                i, j = np.nonzero(sim >= reach - 1e-12)     # products of other shapes differ in the last digits
                s = sim[i, j]
                best = _best(*((i, j) if axis == 0 else (j, i)), s, k)
                found.append((i[best] + strip.start, j[best], s[best]))
        i, j, s = (np.concatenate(c) for c in zip(*rows))
        parts = [(x, y, i, j, s)]
        i, j, s = (np.concatenate(c) for c in zip(*cols))
        best = _best(j, i, s, k)
        parts.append((y, x, j[best], i[best], s[best]))
        return made(pdf, parts)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "id").orderBy(F.col("cosine").desc(), F.col("nbr"))
        return found.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)

    spark = df.sparkSession
    usable = usable_vectors(narrow_vectors(df, vec_col), id_col, vec_col, keys, unique)
    largest = _largest(usable, keys)
    pruned = largest > PRUNE_FROM * block_size
    if pruned:
        rows, blocks, angles = _cut(usable, keys, id_col, vec_col, rows_a_block(largest, block_size))
    else:
        rows = stage(_placed(usable, keys, id_col, vec_col, block_size), "vectors")
    cand = stage(rows.groupBy(*keys, "_b").applyInPandas(inside, out), "own-block")
    # a row with fewer than k others in its block has no bound yet
    bounds = cand.groupBy(*keys, F.col("id").alias("_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("_bound"))
    bounded = rows.join(bounds, [*keys, "_id"], "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("-inf"))))
    if pruned:
        pairs, blocks_ = neighbour_block_pairs(blocks, angles, cand, k, keys), _on_ring(blocks, keys)
        n, nb = blocks_.agg(F.sum("_n"), F.max("_blocks")).first()
    else:
        n, nb = rows.agg(F.count(F.lit(1)), F.max("_nb")).first()
    rounds = _rounds(n, nb or 0, 1)
    if len(rounds) > 1:
        own, bounded = cand, stage(bounded, "bounded")
        if pruned:
            pairs = stage(_ring_pairs(pairs, blocks_, keys), "block-pairs")
        drop_staged(spark, rows)
        cand = own.drop("_b")
    for first, last in rounds if len(rounds) > 1 else []:
        if pruned:
            dealt = _dealt(bounded, pairs.where(F.col("_apart").between(first, last)), keys)
        else:
            dealt = _paired(bounded.where("_nb > 1"), keys, ["_bound"], first, last)
        found = dealt.groupBy(*keys, "_lo", "_hi").applyInPandas(across, out).drop("_b")
        before, cand = cand, stage(best(cand.unionByName(found)).drop("nn_rank"), "nearest")
        drop_staged(spark, before)
    if len(rounds) > 1:
        drop_staged(spark, bounded)
        return best(cand)
    if pruned:
        dealt = _dealt(bounded, pairs, keys)
    else:
        dealt = _paired(bounded.where("_nb > 1"), keys, ["_bound"]).where("_lo < _hi")
    return best(cand.unionByName(dealt.groupBy(*keys, "_lo", "_hi").applyInPandas(across, out)).drop("_b"))


def _on_ring(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``_b``, ``_n``, the block's place ``_i`` on the ring of its group and the number ``_blocks`` of blocks there."""
    w = Window.partitionBy(*keys)
    return blocks.select(*keys, "_b", "_n", F.row_number().over(w.orderBy("_b")).alias("_i"), F.count(F.lit(1)).over(w).alias("_blocks"))


def _ring_pairs(pairs: DataFrame, ring: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, ``_lo``, ``_hi``) with ``_apart``, the distance of the two blocks on the ring."""
    lo = ring.select(*keys, F.col("_b").alias("_lo"), F.col("_i").alias("_il"), "_blocks")
    hi = ring.select(*keys, F.col("_b").alias("_hi"), F.col("_i").alias("_ih"))
    return pairs.join(lo, [*keys, "_lo"]).join(hi, [*keys, "_hi"]).select(
        *keys, "_lo", "_hi", _ring_distance(F.col("_il"), F.col("_ih"), F.col("_blocks")).alias("_apart"))


def neighbour_block_pairs(blocks: DataFrame, angles: DataFrame, own: DataFrame, k: int, keys) -> DataFrame:
    """The pairs of different blocks that may hold a k-th neighbour, given each row's best ``k`` of its own block."""
    keys = list(keys)
    # a block of more than k rows gives every row k candidates, so the worst of them all is a bound
    worst = own.groupBy(*keys, "_b").agg(F.min("cosine").alias("_worst"))
    reach = F.when(F.col("_n") > k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_worst")))) + 1e-7).otherwise(F.lit(float(np.pi)))
    bounded = stage(blocks.join(worst, [*keys, "_b"], "left").withColumn("_reach", reach).drop("_worst"), "bounded")
    return block_pairs(bounded, angles, keys).where(
        (F.col("_lo") < F.col("_hi")) & (F.col("_gap") <= F.greatest("_reacha", "_reachb")))


def spanning_edges(df: DataFrame, core: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "vec", keys=(),
                   block_size: int = DEFAULT_BLOCK, unique: bool = False, written: bool = False) -> DataFrame:
    """Edges among which every group's minimum spanning tree by mutual reachability lies.

    Weight of a pair: ``greatest(core_a, core_b, 1 - cosine)``, rounded to twelve digits. ``core`` is keys,
    ``id``, ``core``; without it the weight is the distance. Each block, and each pair of blocks, gives the edges
    of its own spanning tree (of a pair of blocks those that cross it): an edge that is the heaviest of a cycle
    there is so in the whole group, so none that is needed is lost. A block pair of n rows gives fewer than n
    edges, however many of its pairs are near. If block pairs come in several rounds, every round's edges are
    written, and more than ``THIN_FROM`` a row are thinned to the spanning forest of those so far. ``written``: the
    edges of a single round are, too. Output: keys, ``u`` < ``v``, ``w``."""
    keys = list(keys)
    if not keys:
        core = core if core is None else core.withColumn("_g", F.lit(0))
        return spanning_edges(df.withColumn("_g", F.lit(0)), core, id_col, vec_col, ["_g"], block_size, unique, written).drop("_g")
    spark = df.sparkSession
    rows = usable_vectors(narrow_vectors(df.select(*keys, F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")), "_v"), "_id", "_v", keys, unique)
    if core is None:
        rows = rows.withColumn("_core", F.lit(0.0))
    else:
        rows = rows.join(core.select(*keys, F.col("id").alias("_id"), F.coalesce("core", F.lit(0.0)).alias("_core")), [*keys, "_id"])
    rows = stage(rows, "points")        # before rows are copied; written, since blocks are counted first
    placed = _placed(rows, keys, "_id", "_v", block_size, TREE_BLOCKS, LARGE_TREE_BLOCK, ["_core"])
    n, nb = placed.agg(F.count(F.lit(1)), F.max("_nb")).first()
    rounds = _rounds(n, nb or 0, 0)
    one = keys == ["_g"] and n > LARGE_TREE_BLOCK       # few block pairs, long tasks: dealt to more partitions than pairs

    def trees(first: int, last: int) -> DataFrame:
        dealt = _paired(placed, keys, ["_core"], first, last if len(rounds) > 1 else None)
        if one:
            dealt = dealt.repartition(4 * nb * (last - first + 1), *keys, "_lo", "_hi")
        return _block_trees(dealt, keys, keys)

    if len(rounds) == 1 and not written:
        return trees(*rounds[0])
    edges, held = None, 0
    for first, last in rounds:
        new = stage(trees(first, last), "block-trees")
        edges, held = new if edges is None else edges.unionByName(new), held + new.count()
        if held > THIN_FROM * n and (first, last) != rounds[-1]:
            from themelens.operators.hierarchy import spanning_forest
            forest = spanning_forest(edges, keys)
            thin = stage(forest, "block-trees")
            drop_staged(spark, edges, forest)
            edges, held = thin, thin.count()
    drop_staged(spark, rows)
    return edges


def windowed_spanning_edges(rows: DataFrame, span: int, step_col: str = "step", id_col: str = "vec_id",
                            vec_col: str = "vec", keys=(), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Edges among which the minimum spanning tree (by distance) of every window of ``span`` successive steps lies.

    Blocks hold rows of one step, and blocks less than ``span`` steps apart meet once, whatever number of windows
    holds both. An edge that is the heaviest of a cycle in two blocks is so in every window with both, so a
    window's tree lies among the edges of its block pairs, as in ``spanning_edges``. ``rows`` are usable
    (``usable_vectors``). Output: keys, ``u`` < ``v``, ``w``, ``lo`` <= ``hi`` (the steps of the two ends)."""
    keys = list(keys)
    base = rows.select(*keys, F.col(step_col).cast("long").alias("_step"), F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    parts = base.groupBy(*keys, "_step").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_size)).alias("_parts"))
    number = F.col("_step") * F.lit(1 << 32)
    placed = base.join(parts, [*keys, "_step"]).withColumn("_b", number + F.pmod(F.xxhash64("_id"), F.col("_parts")))
    blocks = parts.select(*keys, "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_s"))
    blocks = blocks.select(*keys, "_step", (number + F.col("_s")).alias("_b"))
    later = F.explode(F.sequence(F.col("_step"), F.col("_step") + span - 1))
    pairs = (blocks.select(*keys, F.col("_b").alias("_lo"), later.alias("_step"))
             .join(blocks.withColumnRenamed("_b", "_hi"), [*keys, "_step"]).where("_lo <= _hi"))
    rep = _dealt(placed, pairs, keys).withColumn("_core", F.lit(0.0))
    edges = _block_trees(rep, keys, [*keys, "_lo", "_hi"])
    return edges.select(*keys, "u", "v", "w", F.shiftright("_lo", 32).alias("lo"), F.shiftright("_hi", 32).alias("hi"))


def _block_trees(rep: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """The spanning-tree edges of every pair of blocks: the ``carried`` columns, ``u`` < ``v``, ``w``."""
    id_type = rep.schema["_id"].dataType
    out = T.StructType([rep.schema[k] for k in carried] + [
        T.StructField("u", id_type), T.StructField("v", id_type), T.StructField("w", T.DoubleType())])

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        side, ids, core_ = pdf["_b"].to_numpy(), pdf["_id"].to_numpy(), pdf["_core"].to_numpy()
        x = _unit(np.vstack(pdf["_v"].to_numpy()).astype(np.float64))
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        a, b, w = block_pair_edges(x, core_, side == lo, lo != hi)
        first, second = ids[a], ids[b]
        swap = first > second
        res = pd.DataFrame({"u": np.where(swap, second, first), "v": np.where(swap, first, second), "w": w})
        for k in carried:
            res.insert(len(res.columns) - 3, k, pdf[k].iloc[0])
        return res[out.names]

    return rep.groupBy(*keys, "_lo", "_hi").applyInPandas(tree, out)


def block_pair_edges(x: np.ndarray, core: np.ndarray, low: np.ndarray, crossing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of spanning-tree edges of a block, or of those that cross from its ``low`` rows to the others.

    Blocks of more than ``TREE_PART`` rows are cut into parts: every pair of parts gives its tree's edges, and what is
    heaviest of a cycle among these goes, so a task holds the distances of two parts."""
    def cut(rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, max(1, -(-len(rows) * 10 // (TREE_PART * 11))))

    if crossing:
        pairs = [(p, q) for p in cut(np.flatnonzero(low)) for q in cut(np.flatnonzero(~low))]
    else:
        parts = cut(np.arange(len(x)))
        pairs = [(p, q) for i, p in enumerate(parts) for q in parts[i:]]
    found = []
    for p, q in pairs:
        own = p is q
        rows = p if own else np.sort(np.concatenate([p, q]))
        a, b, w = minimum_spanning_tree(x[rows], core[rows])
        a, b = rows[a], rows[b]
        if not own:
            other = np.zeros(len(x), bool)
            other[q] = True
            keep = other[a] != other[b]
            a, b, w = a[keep], b[keep], w[keep]
        found.append((a, b, w))
    a, b, w = (np.concatenate(c) for c in zip(*found))
    if len(pairs) > 1:
        kept = forest_rows(a, b, w)
        a, b, w = a[kept], b[kept], w[kept]
    return a, b, w


def forest_rows(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of edges (ends are numbers from 0) that make up a minimum spanning forest, ties by place."""
    order = np.argsort(w, kind="stable")
    above = list(range(int(max(a.max(), b.max())) + 1)) if len(w) else []
    kept = []
    for i, p, q in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        while above[p] != p:
            above[p] = p = above[above[p]]
        while above[q] != q:
            above[q] = q = above[above[q]]
        if p != q:
            above[q] = p
            kept.append(i)
    return np.array(kept, np.int64)


def minimum_spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree of the rows of ``x`` (unit vectors): ends and weights of its edges."""
    n, sim = len(x), x @ x.T
    left = np.arange(1, n)                      # rows outside the tree, their nearest row in it and its distance
    best, near, last = np.full(n - 1, np.inf), np.zeros(n - 1, np.int64), 0
    a, b, w = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    for k in range(n - 1):
        d = np.round(np.maximum(np.maximum(1 - sim[last][left], core[left]), core[last]), 12)
        d = np.maximum(d, 0.0)
        closer = d < best
        best[closer], near[closer] = d[closer], last
        i = int(np.argmin(best))
        a[k], b[k], w[k], last = near[i], left[i], best[i], left[i]
        end = len(left) - 1                     # drop it by moving the last one into its place
        left[i], best[i], near[i] = left[end], best[end], near[end]
        left, best, near = left[:end], best[:end], near[:end]
    return a, b, w
