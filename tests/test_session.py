"""Staging, its deletion, and the size checks in front of a broadcast."""
import os

from pyspark.sql import functions as F

from themelens import session as S


def _folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://").removeprefix("file:"))


def test_staged_tables_are_dropped(spark):
    a, b = S.stage(spark.range(10), "a"), S.stage(spark.range(5), "b")
    here, there = _folder(a), _folder(b)
    assert a.count() == 10 and os.path.isdir(here)
    S.drop_staged(spark, a)
    assert not os.path.isdir(here) and os.path.isdir(there)
    S.drop_staged(spark)
    assert not os.path.isdir(there) and not S._STAGED


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    df = spark.range(1000).withColumn("t", F.sha2(F.col("id").cast("string"), 256))
    other = spark.range(1000)

    def hinted(**limits):
        return "strategy=broadcast" in other.join(S.checked_broadcast(df, **limits), "id")._jdf.queryExecution().logical().toString()

    assert hinted()
    assert not hinted(max_rows=999) and not hinted(max_bytes=1000)
    S.drop_staged(spark)
