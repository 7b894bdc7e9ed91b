"""J7 (exact pairs, kNN) against NumPy brute force, M3 on the planted pairs (FIXTURES.md §1.4), M5-M7."""
import collections
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from themelens.operators import clusters as M
from themelens.operators import vectors as V

PAIRS3D = [[1, 0, 0], [1.1, 0.1, 0], [0, 1, 0], [0.1, 1.1, 0], [0, 0, 1], [0.1, 0, 1.1]]


def _vecs(spark, mat, group=None):
    rows = [(i, [float(x) for x in v], group[i] if group else 0) for i, v in enumerate(mat)]
    return spark.createDataFrame(rows, "vec_id long, vec array<double>, g int")


@pytest.fixture(scope="module")
def random_vectors():
    rng = np.random.default_rng(7)
    return rng.normal(size=(150, 8))


def _cos(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("block", [16, 1000])
def test_similar_pairs_exact(spark, random_vectors, block):
    s = _cos(random_vectors)
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i, j] >= 0.5}
    got = V.similar_pairs(_vecs(spark, random_vectors), 0.5, block_size=block).collect()
    assert {(r.id_a, r.id_b) for r in got} == want
    for r in got:
        assert abs(r.cosine - s[r.id_a, r.id_b]) < 1e-9


def test_similar_pairs_per_group(spark, random_vectors):
    group = [i % 3 for i in range(len(random_vectors))]
    s = _cos(random_vectors)
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i, j] >= 0.4 and group[i] == group[j]}
    got = V.similar_pairs(_vecs(spark, random_vectors, group), 0.4, keys=["g"], block_size=10).collect()
    assert {(r.id_a, r.id_b) for r in got} == want


def test_nearest_neighbours_exact(spark, random_vectors):
    s = _cos(random_vectors)
    np.fill_diagonal(s, -np.inf)
    got = V.nearest_neighbours(_vecs(spark, random_vectors), 4, block_size=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.nn_rank, r.nbr))
    for i in range(len(s)):
        order = sorted(range(len(s)), key=lambda j: (-s[i, j], j))[:4]
        assert [n for _, n in sorted(by[i])] == order


def test_components_of_string_ids_without_round_limit(spark):
    import random
    random.seed(1)
    for make in (str, lambda i: f"gp:{i}"):
        chain = [(make(i), make(i + 1)) for i in range(60)]
        random.shuffle(chain)
        nodes = spark.createDataFrame([(make(i),) for i in range(62)], "id string")
        labels = {r.id: r.label for r in M.connected_components(nodes, spark.createDataFrame(chain, "src string, dst string")).collect()}
        assert {labels[make(i)] for i in range(61)} == {min(make(i) for i in range(61))} and labels[make(61)] == make(61)


def test_kmeans_only_where_all_is_noise(spark):
    rows = [(k, i, [float(i % 2) * 10 + i * 0.01, float(k)], -1 if k == 0 else i % 2) for k in range(2) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, vec_id long, vec array<double>, cluster_id int")
    runs = [{(r.k, r.vec_id): r.cluster_id for r in M.kmeans_fallback(df.repartition(n), 2, keys=("k",)).collect()} for n in (1, 7)]
    assert runs[0] == runs[1]
    assert all(runs[0][(1, i)] == i % 2 for i in range(20))
    assert len({runs[0][(0, i)] for i in range(0, 20, 2)}) == 1 and runs[0][(0, 0)] != runs[0][(0, 1)]


def test_kmeans_runs_until_centres_rest(spark):
    """A slow case: 40 points on a line, two centres that start at one end. Brute force Lloyd gives the same labels."""
    xs = [[float(i) ** 1.1] for i in range(40)] + [[1000.0]]
    df = spark.createDataFrame([(i, x, -1) for i, x in enumerate(xs)] + [(90, None, -1), (91, [1.0, 2.0], -1)], "vec_id long, vec array<double>, cluster_id int")
    order = [r.vec_id for r in df.where("vec_id < 90").orderBy(F.xxhash64(F.col("vec_id").cast("string")), "vec_id").collect()]
    centres, rounds = [xs[i][0] for i in order[:3]], 0
    while True:
        near = [min(range(3), key=lambda c: ((x[0] - centres[c]) ** 2, c)) for x in xs]
        new = [round(float(np.mean([x[0] for x, n in zip(xs, near) if n == c])), 9) if c in near else centres[c] for c in range(3)]
        rounds += 1
        if new == centres:
            break
        centres = new
    got = {r.vec_id: r.cluster_id for r in M.kmeans_fallback(df, 3).collect()}
    assert [got[i] for i in range(len(xs))] == near and got[90] == got[91] == -1
    with pytest.warns(UserWarning):
        M.kmeans_fallback(df, 3, max_rounds=1).collect()
    plan = M.centroids(df.where("vec_id < 90"))._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert M.kmeans_fallback(df.limit(0), 2).count() == 0


def test_reduce_dims_of_an_empty_table(spark):
    assert V.reduce_dims(spark.createDataFrame([], "vec_id long, vec array<double>"), 2).columns == ["vec_id", "vec", "vec_k"]


def test_number_rows_over_the_whole_table(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    got = M.number_rows(df.repartition(5), [F.col("x").desc(), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [(-r.x, r.id) for r in got] == sorted((-r.x, r.id) for r in got)


def test_density_cluster_planted_pairs(spark):
    v = _vecs(spark, PAIRS3D)
    labels = {r.vec_id: r.cluster_id for r in M.density_cluster(v, eps=0.05, min_cluster_size=2).collect()}
    assert sorted(labels.values()).count(-1) == 0
    assert labels[0] == labels[1] and labels[2] == labels[3] and labels[4] == labels[5]
    assert len(set(labels.values())) == 3
    all_noise = M.density_cluster(v, eps=0.05, min_cluster_size=3).collect()
    assert {r.cluster_id for r in all_noise} == {-1}
    one = M.density_cluster(_vecs(spark, PAIRS3D[:1]), eps=0.05, min_cluster_size=2).collect()
    assert [r.cluster_id for r in one] == [-1]


def test_merge_and_representatives(spark):
    mat = PAIRS3D + [[1, 0.05, 0], [0.9, 0, 0.05]]
    cl = [0, 0, 1, 1, 2, 2, 3, 3]
    rows = [(i, [float(x) for x in v], c) for i, (v, c) in enumerate(zip(mat, cl))]
    v = spark.createDataFrame(rows, "vec_id long, vec array<double>, cluster_id int")
    merged = {r.cluster_id: r.merged_id for r in M.merge_similar_clusters(v, 0.9).collect()}
    assert merged == {0: 0, 1: 1, 2: 2, 3: 0}
    reps = M.cluster_representatives(v, 1).collect()
    assert len(reps) == 4 and all(r.rep_rank == 1 for r in reps)


def test_keyword_fallback_only_where_needed(spark):
    rows = [("p", "w1", 0, "crash"), ("p", "w1", 1, "fee"), ("p", "w2", -1, "crash now"), ("p", "w2", -1, "nice")]
    df = spark.createDataFrame(rows, "product_id string, iso_week string, cluster_id int, content string")
    got = sorted((r.iso_week, r.content, r.cluster_id) for r in M.keyword_fallback(df).collect())
    assert got == [("w1", "crash", 0), ("w1", "fee", 1), ("w2", "crash now", 1), ("w2", "nice", 2)]


def test_embed_and_user_hook(spark):
    df = spark.createDataFrame([("1", "crash on login"), ("2", "login fails\nagain")], "review_id string, content string")
    e = V.embed_texts(df, num_features=64).collect()
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in e)
    hooked = V.embed_with(df, lambda ts: [[float(len(t))] for t in ts]).collect()
    assert sorted(r.vec[0] for r in hooked) == [14.0, 17.0]
    with pytest.raises(Exception):
        V.embed_with(df, lambda ts: []).collect()


def test_vectors_of_two_weekly_runs_are_comparable(spark, tmp_path):
    """Counts are stored by week and add up; a version's vector of a text is the same in every run."""
    from pyspark.ml.feature import HashingTF

    from themelens.sources import tables as TB
    rows = [("1", "w1", "crash on login"), ("2", "w1", "login fails\nagain login"), ("3", "w2", "crash again"), ("4", "w2", None), ("5", "w3", "fee")]
    df = spark.createDataFrame(rows, "review_id string, iso_week string, content string")
    path = f"{tmp_path}/counts"
    for weeks in (["w1", "w2"], ["w2"], ["w3"]):            # w2 is counted twice: replaced, not added
        TB.write_document_counts(V.document_counts(df.where(F.col("iso_week").isin(weeks)), num_features=64), path)
    counts = TB.load_document_counts(spark, path)
    assert {r.iso_week: r.n_docs for r in counts.collect()} == {"w1": 2, "w2": 2, "w3": 1}
    at, texts = HashingTF(numFeatures=64), {i: re.findall(r"\w{5,}", t or "") for i, _, t in rows}
    count = Counter(b for i in "1234" for b in {at.indexOf(w) for w in texts[i]})
    want = {}
    for i, words in texts.items():
        v = np.zeros(64)
        for w in words:
            v[at.indexOf(w)] += np.log(5 / (1 + count[at.indexOf(w)])) + 1
        want[i] = v / (np.linalg.norm(v) or 1)
    first = {r.review_id: r for r in V.embed_with_counts(df.where("iso_week <= 'w2'"), counts.where("iso_week <= 'w2'"), "w2").collect()}
    later = {r.review_id: r for r in V.embed_with_counts(df, counts, "w2", dense=True).collect()}
    assert all(np.allclose(later[i].vec, want[i]) and later[i].vec_version == "w2" for i in want)
    assert all(np.array_equal(first[i].vec.toArray(), later[i].vec) for i in first) and type(first["1"].vec).__name__ == "SparseVector"
    assert V.embed_with_counts(df.limit(0), counts, "w3").count() == 0 and V.document_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        V.embed_with_counts(df, counts, "w0")
    with pytest.raises(ValueError):
        V.embed_with_counts(df, counts.unionByName(V.document_counts(df.where("iso_week = 'w1'"), num_features=32)), "w3")


def _clustered(n_clusters, size, spread, dims=16, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dims))
    return np.vstack([c + spread * rng.normal(size=(size, dims)) for c in centres])


def test_block_pairs_are_skipped_on_clustered_vectors(spark):
    """Same answers as brute force, and most block pairs are never built."""
    mat = _clustered(24, 50, 0.05)
    s = _cos(mat)
    v = _vecs(spark, mat).withColumn("k", F.lit("a"))
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i, j] >= 0.9}
    assert {(r.id_a, r.id_b) for r in V.similar_pairs(v, 0.9, keys=["k"], block_size=50).collect()} == want
    np.fill_diagonal(s, -np.inf)
    by = {}
    for r in V.nearest_neighbours(v, 5, keys=["k"], block_size=50).collect():
        by.setdefault(r.id, []).append((r.nn_rank, r.nbr))
    for i in range(len(s)):
        assert [n for _, n in sorted(by[i])] == sorted(range(len(s)), key=lambda j: (-s[i, j], j))[:5]
    rows, blocks, angles = V._cut(v, ["k"], "vec_id", "vec", 50)
    every = V.block_pairs(blocks, angles, ["k"])
    total = every.count()
    kept = every.where("_lo = _hi OR _gap <= acos(0.9)").count()
    n_blocks = blocks.count()
    assert total == n_blocks * (n_blocks + 1) // 2 and n_blocks >= 24
    assert kept <= 0.35 * total, (kept, total)
    assert rows.count() == len(mat) and blocks.agg(F.max("_n")).first()[0] <= 100


def test_pivot_blocks_of_mixed_groups_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "PRUNE_FROM", 1)
    rng = np.random.default_rng(2)
    mat = np.vstack([rng.normal(size=(90, 4)), np.zeros((3, 4)), -np.ones((4, 4))])
    group = [0] * 80 + [1] * 17
    s = _cos(np.where(np.abs(mat).sum(axis=1, keepdims=True) > 0, mat, 1.0))
    zero = np.abs(mat).sum(axis=1) == 0
    s[zero, :] = 0
    s[:, zero] = 0
    for threshold in (0.3, -0.2, 1.0 - 1e-9):
        want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i, j] >= threshold and group[i] == group[j]}
        got = V.similar_pairs(_vecs(spark, mat, group), threshold, keys=["g"], block_size=15).collect()
        assert {(r.id_a, r.id_b) for r in got} == want


def _stepped(n=90, products=("a", "b"), seed=5):
    """Rows around a few directions, over eight steps."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    return [(p, f"{p}{i:03d}", int(rng.integers(0, 8)), (centres[rng.integers(0, 6)] + 0.25 * rng.normal(size=8)).tolist())
            for p in products for i in range(n)]


@pytest.mark.parametrize("eps", [None, 0.12])
def test_windows_share_vectors_with_the_same_labels(spark, eps):
    rows = _stepped() + [("a", "none", 3, None), ("b", "nan", 4, [float("nan")] * 8), ("a", None, 3, [1.0] * 8)]
    df = spark.createDataFrame(rows, "product_id string, id string, step long, vec array<double>")
    got = M.density_cluster_windows(df, 3, 1, 9, eps, 3, "id", "vec", block_size=8).collect()
    copies = df.withColumn("window", F.explode(F.sequence("step", F.col("step") + 2))).where("window between 1 and 9")
    want = M.density_cluster(copies, eps, 3, 1, "id", "vec", ["product_id", "window"]).collect()
    key = lambda r: (r.product_id, r.window, str(r.id), r.cluster_id)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({r.cluster_id for r in got}) > 2
    wanted = spark.createDataFrame([("a", 4), ("c", 4)], "product_id string, window long")
    some = M.density_cluster_windows(df, 3, 1, 9, eps, 3, "id", "vec", wanted=wanted, block_size=8).collect()
    assert sorted(map(key, some)) == sorted(key(r) for r in want if (r.product_id, r.window) == ("a", 4))
    assert M.density_cluster_windows(df.limit(0), 3, 1, 9, eps, 3, "id", "vec").collect() == []


def test_windows_compare_each_pair_of_blocks_once(spark):
    n, span = 60, 3
    rows = [("p", i, i % 6, [1.0, 0.0]) for i in range(n)]
    df = spark.createDataFrame(rows, "product_id string, id long, step long, vec array<double>")
    edges = V.windowed_spanning_edges(df, span, "step", "id", "vec", ["product_id"], 10).collect()
    per_pair = collections.Counter((e.lo, e.hi) for e in edges)
    assert set(per_pair) == {(a, b) for a in range(6) for b in range(a, min(a + span, 6))}
    assert max(per_pair.values()) < 20              # fewer than the rows of a block pair, though all pairs are equal
