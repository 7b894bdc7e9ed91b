"""M3 without a threshold: the hierarchy against a plain top-down form, planted densities, edges written."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_vectors_clusters import PAIRS3D, _vecs
from themelens.operators import clusters as M
from themelens.operators import hierarchy as H
from themelens.operators import vectors as V


def _weights(mat, min_samples):
    u = np.array(mat, float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    d = np.maximum(0, 1 - u @ u.T)
    core = np.array([sorted(np.delete(r, i))[min_samples - 1] if len(r) > min_samples else 0.0 for i, r in enumerate(d)])
    return np.round(np.maximum(np.maximum(d, core[:, None]), core[None, :]), 12)


def _tree(w):
    parent = list(range(len(w)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for x, i, j in sorted((w[i, j], i, j) for i in range(len(w)) for j in range(i + 1, len(w))):
        if root(i) != root(j):
            parent[root(j)] = root(i)
            out.append((x, i, j))
    return out


def _split(points, edges):
    """The two sides of the heaviest (last) edge."""
    (w, a, _), rest = edges[-1], edges[:-1]
    side, grown = {a}, True
    while grown:
        grown = False
        for _, i, j in rest:
            if (i in side) != (j in side):
                side |= {i, j}
                grown = True
    return w, [(s, [e for e in rest if e[1] in s]) for s in (side, points - side)]


def _cluster(points, edges, birth, size):
    """Stability and the best clusters of one cluster, from the top down."""
    stability, now, at = 0.0, points, edges
    while True:
        if not at:
            return stability, [points]
        w, parts = _split(now, at)
        lam = 1 / max(w, H.LEAST_WEIGHT)
        big = [p for p in parts if len(p[0]) >= size]
        if len(big) == 1:
            stability += (len(now) - len(big[0][0])) * (lam - birth)
            now, at = big[0]
            continue
        stability += len(now) * (lam - birth)
        if not big:
            return stability, [points]
        below = [_cluster(*p, lam, size) for p in big]
        total = sum(s for s, _ in below)
        return (stability, [points]) if stability >= total else (total, [c for _, cs in below for c in cs])


def plain_hierarchy(mat, size, min_samples=1):
    """Labels by the definition; the root is never chosen."""
    if len(mat) < size:
        return set()
    points, at = set(range(len(mat))), _tree(_weights(mat, min_samples))
    while at:
        w, parts = _split(points, at)
        big = [p for p in parts if len(p[0]) >= size]
        if len(big) == 2:
            return {frozenset(c) for p in big for c in _cluster(*p, 1 / max(w, H.LEAST_WEIGHT), size)[1]}
        if not big:
            return set()
        points, at = big[0]
    return set()


def _found(rows, key=lambda r: 0):
    out = {}
    for r in rows:
        if r.cluster_id >= 0:
            out.setdefault((key(r), r.cluster_id), set()).add(r.vec_id)
    return {frozenset(v) for v in out.values()}


def _blobs(seed, sizes, spreads, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dims)) * 3
    return np.vstack([c + rng.normal(size=(n, dims)) * s for c, n, s in zip(centres, sizes, spreads)])


@pytest.mark.parametrize("size, samples, block, batch", [(3, 2, 1000, 10**6), (5, 1, 16, 10**6), (4, 3, 16, 20)])
def test_hierarchy_as_defined(spark, size, samples, block, batch):
    mat = np.vstack([_blobs(size, [25, 18, 12], [0.05, 0.3, 0.6]), np.random.default_rng(1).normal(size=(15, 6)) * 3])
    labels = H.hierarchical_labels(_vecs(spark, mat).withColumn("k", F.lit(1)), size, samples, keys=["k"], block_size=block, batch_edges=batch).collect()
    got = {}
    for r in labels:
        if r.label is not None:
            got.setdefault(r.label, set()).add(r.id)
    assert len(labels) == len(mat)
    assert {frozenset(v) for v in got.values()} == plain_hierarchy(mat, size, samples) and len(got) >= 2


def test_clusters_of_different_density_are_recovered(spark):
    """No single eps separates the dense pair of clusters and keeps the loose one whole."""
    rng = np.random.default_rng(4)
    base = np.eye(6)
    tight = [base[0] + 0.002 * rng.normal(size=6) for _ in range(20)] + [base[0] + 0.06 * base[1] + 0.002 * rng.normal(size=6) for _ in range(20)]
    loose = [base[3] + 0.12 * rng.normal(size=6) for _ in range(30)]
    got = _found(M.density_cluster(_vecs(spark, np.array(tight + loose)), min_cluster_size=8).collect())
    assert {frozenset(range(20)), frozenset(range(20, 40))} <= got
    rest = max((c for c in got if min(c) >= 40), key=len)
    assert len(rest) >= 20


def test_planted_pairs_and_small_groups(spark):
    assert _found(M.density_cluster(_vecs(spark, PAIRS3D)).collect()) == {frozenset(x) for x in ((0, 1), (2, 3), (4, 5))}
    assert _found(M.density_cluster(_vecs(spark, PAIRS3D), min_cluster_size=3).collect()) == set()
    assert [r.cluster_id for r in M.density_cluster(_vecs(spark, PAIRS3D[:1])).collect()] == [-1]
    two = _vecs(spark, PAIRS3D + PAIRS3D[:2], [0] * 6 + [1] * 2)
    got = M.density_cluster(two, keys=["g"]).collect()
    assert len(got) == 8 and {r.cluster_id for r in got if r.g == 1} == {-1}


@pytest.mark.parametrize("eps", [None, 0.05])
def test_rows_without_a_usable_vector_are_noise(spark, eps):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(PAIRS3D)]
    rows += [(6, None), (7, []), (8, [1.0, 2.0]), (9, [1.0, None, 0.0]), (10, [float("nan"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>").selectExpr("*", "1 AS w", "2 AS label", "'x' AS core")
    got = M.density_cluster(df, eps).collect()
    assert len(got) == len(rows) and {r.vec_id for r in got if r.cluster_id == -1} == {6, 7, 8, 9, 10, None}
    assert _found(got) == {frozenset(x) for x in ((0, 1), (2, 3), (4, 5))}
    assert M.density_cluster(df.limit(0), eps).count() == 0
    assert V.similar_pairs(df, 0.9).count() == 3 and V.nearest_neighbours(df, 1).count() == 6
    assert V.similar_pairs(df.limit(0), 0.9).count() == 0 and V.nearest_neighbours(df.limit(0), 2).count() == 0


def test_edges_written_stay_below_the_rows_of_a_block_pair(spark):
    same = _vecs(spark, np.ones((120, 4)))
    edges = V.spanning_edges(same, block_size=40)
    blocks = {r[0] for r in V._blocked(same.withColumn("_g", F.lit(0)), ["_g"], "vec_id", "vec", 40).select("_lo").collect()}
    pairs = len(blocks) * (len(blocks) + 1) // 2
    assert len(blocks) > 1 and 119 <= edges.count() < 120 * pairs       # all pairs would be 7140
    assert H.spanning_forest(edges.withColumn("k", F.lit(0)), ["k"]).count() == 119
    assert {r.cluster_id for r in M.density_cluster(same, 0.1, block_size=40).collect()} == {0}


def test_forest_weight(spark):
    mat = _blobs(3, [30, 25], [0.3, 0.5])
    edges = V.spanning_edges(_vecs(spark, mat).withColumn("k", F.lit("a")), keys=["k"], block_size=12)
    forest = H.spanning_forest(edges, ["k"]).collect()
    want = _tree(_weights(mat, 1))
    assert len(forest) == len(want) and abs(sum(r.w for r in forest) - sum(x for x, *_ in want)) < 1e-9


def test_forest_in_parts_and_rounds(spark):
    """Groups of more edges than a task may hold are dealt into parts, then joined by Boruvka rounds: the same forest."""
    mat = np.random.default_rng(5).normal(size=(150, 4))
    edges = V.spanning_edges(_vecs(spark, mat).withColumn("k", F.lit(1)), keys=["k"], block_size=20)
    whole = {tuple(r) for r in H.spanning_forest(edges, ["k"]).collect()}
    assert len(whole) == 149 < edges.count()
    for size in (60, 10):
        assert {tuple(r) for r in H.spanning_forest(edges, ["k"], size).collect()} == whole


def test_rows_are_copied_to_few_blocks(spark):
    """The least size of a block does not set the number of copies of a row."""
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("vec"))
    assert V._blocked(rows, ["k"], "vec_id", "vec", 8).count() == 4000 * V.BLOCKS
    assert V._placed(rows, ["k"], "vec_id", "vec", 8, V.TREE_BLOCKS, V.LARGE_TREE_BLOCK).agg(F.max("_nb")).first()[0] == V.TREE_BLOCKS
    assert V.rows_a_block(10**6, 128) == V.LARGE_BLOCK and V.rows_a_block(100, 128) == 128 and V.rows_a_block(10**6, 10**5) == 10**5


@pytest.mark.parametrize("block", [5, 12])
def test_neighbours_come_in_rounds_of_few_copies(spark, monkeypatch, block):
    """Blocks around pivots (5) and by hash (12): the rounds give the neighbours that one pass over all block pairs gives."""
    rows = _vecs(spark, np.random.default_rng(8).normal(size=(120, 3)).astype(np.float32))
    one = {(r.id, r.nbr, r.nn_rank) for r in V.nearest_neighbours(rows, 2, block_size=block).collect()}
    monkeypatch.setattr(V, "IN_FLIGHT", 8 * 120)
    assert {(r.id, r.nbr, r.nn_rank) for r in V.nearest_neighbours(rows, 2, block_size=block).collect()} == one and len(one) == 240
    assert V._rounds(120, 11, 1) == [(1, 4), (5, 5)] and V._rounds(10**9, 5, 0) == [(0, 0), (1, 1), (2, 2)]
    placed = V._placed(rows.withColumn("_g", F.lit(0)), ["_g"], "vec_id", "vec", block)
    n = [V._paired(placed, ["_g"], (), *r).count() for r in V._rounds(120, placed.first()["_nb"], 0)]
    assert max(n) <= 960 and sum(n) == V._paired(placed, ["_g"]).count()       # eight copies of every row at a time


def test_hierarchy_in_rounds_leaves_edges_not_vectors(spark, monkeypatch):
    """Rounds and thinning between them keep the clusters; staged vectors go."""
    from themelens import session as S
    mat = np.vstack([_blobs(6, [40, 30, 25], [0.05, 0.2, 0.4]), np.random.default_rng(2).normal(size=(25, 6)) * 3])
    rows = _vecs(spark, mat).withColumn("k", F.lit(1))
    monkeypatch.setattr(V, "IN_FLIGHT", 4 * len(mat))
    monkeypatch.setattr(V, "THIN_FROM", 1)
    before = set(S._STAGED)
    edges = V.spanning_edges(rows, None, keys=["k"], block_size=10, written=True)
    assert not [p for p in set(S._STAGED) - before if "/vectors-" in p or "/points-" in p]
    assert edges.count() < 4 * len(mat)
    forest = H.spanning_forest(edges, ["k"]).collect()
    want = _tree(_weights(mat, 1))
    assert len(forest) == len(want) and abs(sum(r.w for r in forest) - sum(x for x, *_ in want)) < 1e-9
    before = set(S._STAGED)
    found = {}
    for r in H.hierarchical_labels(rows, 5, 2, keys=["k"], block_size=10).collect():
        if r.label is not None:
            found.setdefault(r.label, set()).add(r.id)
    assert {frozenset(v) for v in found.values()} == plain_hierarchy(mat, 5, 2)
    assert not [p for p in set(S._STAGED) - before if "/vectors-" in p or "/points-" in p or "/bounded-" in p or "/cells-" in p]


def test_parts_of_a_block_give_its_tree(monkeypatch):
    """A block cut into parts, alone or with another one, keeps edges that hold the spanning tree."""
    mat = np.random.default_rng(9).normal(size=(90, 5))
    x, core, low = V._unit(mat), np.zeros(90), np.arange(90) % 3 > 0
    whole = sum(w for w, *_ in _tree(_weights(mat, 1)))
    monkeypatch.setattr(V, "TREE_PART", 10)
    a, b, w = V.block_pair_edges(x, core, low, False)
    assert len(w) == 89 and abs(w.sum() - whole) < 1e-9
    found = [V.block_pair_edges(x, core, low, True)]
    assert (low[found[0][0]] != low[found[0][1]]).all() and len(found[0][2]) < 90
    for side in (low, ~low):
        a, b, w = V.block_pair_edges(x[side], core[side], np.ones(side.sum(), bool), False)
        found.append((np.flatnonzero(side)[a], np.flatnonzero(side)[b], w))
    a, b, w = (np.concatenate(c) for c in zip(*found))
    assert abs(w[V.forest_rows(a, b, w)].sum() - whole) < 1e-9


def test_vectors_are_narrowed_only_if_nothing_is_lost(spark):
    assert V.narrow_vectors(_vecs(spark, [[0.5, 0.25], [1, 2]]), "vec").schema["vec"].dataType.simpleString() == "array<float>"
    assert V.narrow_vectors(_vecs(spark, [[0.5, 0.25], [0.1, 2]]), "vec").schema["vec"].dataType.simpleString() == "array<double>"
