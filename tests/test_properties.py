"""Properties: Spark expressions agree with Python's regex/str semantics on
generated text; pipeline invariants hold on the driver's data."""
import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themelens import constants as C
from themelens.functions import text as T
from themelens.session import stage

ALPHABET = "0123456789 -.()+@_abcXYZéß\n\t" + "٣"     # includes a non-ASCII digit
texts = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=60, max_size=60)
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def py_scrub(t):
    if not t:
        return t
    t = re.sub(C.EMAIL_PATTERN, C.EMAIL_MASK, t)
    t = re.sub(C.PHONE_PATTERN, C.PHONE_MASK, t)
    return re.sub(C.CARD_PATTERN, C.CARD_MASK, t)


@SETTINGS
@given(texts)
def test_scrub_matches_python_re(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", T.scrub_pii("t").alias("s")).collect()}
    assert [got[i] for i in range(len(batch))] == [py_scrub(t) for t in batch]


words = st.lists(st.text(alphabet="abcdeéßü_19 ÀÉ", min_size=0, max_size=30), min_size=60, max_size=60)


@SETTINGS
@given(words)
def test_tokens_and_title_match_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    rows = {r.i: r for r in df.select("i", T.tokens("t").alias("k"), T.normalise_whitespace("t").alias("n"))
            .collect()}
    for i, t in enumerate(batch):
        assert list(rows[i].k) == re.findall(r"\w{5,}", t.lower())
        assert rows[i].n == " ".join(t.split())
    toks = sorted({w for t in batch for w in re.findall(r"\w{5,}", t.lower())})
    if toks:
        tdf = spark.createDataFrame([(w,) for w in toks], "w string")
        assert [r.x for r in tdf.orderBy("w").select(T.title_word("w").alias("x")).collect()] == \
            [w.title() for w in sorted(toks)]


SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@needs_data
def test_summary_invariants(spark):
    from themelens.plans import catalog as Cat
    s = Cat.summaries(spark, SF)
    for r in s.collect():
        names = [t.name for t in r.top_themes]
        assert len(names) == len(set(names))                            # unique per key
        assert 1 <= len(names) <= C.TOP_THEMES
        assert sum(t.review_count for t in r.top_themes) <= r.total_reviews_analyzed
    g = Cat.grouped(spark, SF)
    sizes = g.groupBy("product_id", "iso_week").agg(F.count(F.lit(1)).alias("n"))
    totals = {(r.product_id, r.iso_week): r.total_reviews_analyzed for r in s.collect()}
    assert {(r.product_id, r.iso_week): r.n for r in sizes.collect()} == totals   # sizes + noise = total


@needs_data
def test_grounded_quotes_are_substrings(spark):
    from themelens.plans import catalog as Cat
    got = Cat.registry()["ground_quotes"](spark, SF)
    src = Cat.grouped(spark, SF).select("review_id", "content")
    for r in got.join(src, got.source_review_id == src.review_id).collect():
        assert r.text.lower() in " ".join(r.content.split()).lower()


@needs_data
def test_backfill_rollup_equals_copy_path(spark):
    from themelens.plans import catalog as Cat
    from themelens.plans import weekly as P
    from themelens.sources import testdata as D
    r = D.reviews(spark, SF)
    args = dict(groups=Cat.DRIVER_GROUPS, generated_at=Cat.AS_OF)
    rolled = P.backfill(r, "2024-W02", "2024-W04", weeks=3, **args)
    copied = P.backfill(r, "2024-W02", "2024-W04", weeks=3,
                        cluster_fn=lambda df: df.withColumn("cluster_id", F.lit(-1)), **args)

    def norm(df):
        return sorted((x.product_id, x.iso_week, x.total_reviews_analyzed, x.data_window,
                       tuple((t.name, t.review_count, t.summary, tuple(q.text for q in t.quotes)) for t in x.top_themes))
                      for x in df.collect())
    assert norm(rolled) == norm(copied)


@needs_data
@pytest.mark.parametrize("eps", [None, 0.1])
def test_backfill_with_vectors_equals_copy_path(spark, eps):
    from themelens.operators.clusters import density_cluster
    from themelens.plans import catalog as Cat
    from themelens.plans import weekly as P
    from themelens.sources import testdata as D
    r = D.reviews(spark, SF)
    # vectors in a few directions, some reviews without one
    code = F.xxhash64("review_id")
    vec = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i == F.pmod(code, F.lit(5)), 4.0).otherwise(0.0)
                      + F.pmod(F.xxhash64("review_id", i), F.lit(1000)) / 1000.0)
    vectors = stage(r.where(F.pmod(code, F.lit(11)) != 0).select("review_id", vec.alias("vec")), "vectors")
    args = dict(groups=Cat.DRIVER_GROUPS, generated_at=Cat.AS_OF)

    def by_density(df):
        labels = density_cluster(df.select("product_id", "iso_week", "review_id").join(vectors, "review_id"), eps, 2, 1,
                                 "review_id", "vec", ["product_id", "iso_week"])
        out = df.join(labels, ["product_id", "iso_week", "review_id"], "left")
        return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))

    def norm(df):
        return sorted((x.product_id, x.iso_week, x.total_reviews_analyzed, x.data_window,
                       tuple((t.name, t.review_count, t.summary, tuple(q.text for q in t.quotes)) for t in x.top_themes))
                      for x in df.collect())
    want = norm(P.backfill(r, "2024-W02", "2024-W04", weeks=3, cluster_fn=by_density, **args))
    assert norm(P.backfill(r, "2024-W02", "2024-W04", weeks=3, vectors=vectors, eps=eps, **args)) == want
    asked = r.select("product_id").distinct().withColumn("iso_week", F.lit("2024-W03"))
    got = norm(P.backfill(r, "2024-W02", "2024-W04", weeks=3, vectors=vectors, eps=eps, requested=asked, **args))
    assert got == [x for x in want if x[1] == "2024-W03"]
    with pytest.raises(TypeError):
        P.backfill(r, "2024-W02", "2024-W04", vectors=vectors, cluster_fn=by_density)
