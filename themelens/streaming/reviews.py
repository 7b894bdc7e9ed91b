"""Structured Streaming (ST1, ST2).

ST1 reads newly landed review files, scrubs them and appends those whose ``(source, review_id)`` it has not
seen yet, however late they land; the keys seen are state of the query. ST2 keeps weekly counts per product (Monday-based tumbling windows) in update
mode and upserts each micro-batch into a keyed Parquet table. Both run with a checkpoint in the
shared checkpoint folder, so a restarted query resumes where it stopped; ``availableNow`` drains what
has landed and stops (the batch-style way to run a stream).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelens.functions.text import scrub_pii
from themelens.session import checkpoint_dir


def _tz(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.session.timeZone")


def ntz_as_instant(c: Column, tz: str) -> Column:
    """A ``timestamp_ntz`` wall clock read as UTC, whatever the session time zone."""
    return F.from_utc_timestamp(c.cast("timestamp"), tz)


def instant_as_ntz(c: Column, tz: str) -> Column:
    """Back: the UTC wall clock of an instant, as ``timestamp_ntz``."""
    return F.to_utc_timestamp(c, tz).cast("timestamp_ntz")


def append_batch(batch: DataFrame, epoch: int, sink: str, part: str) -> None:
    """Append a micro-batch in a folder of its own, so a replayed batch replaces itself. Nothing that the sink
    holds is read."""
    batch.write.mode("overwrite").partitionBy(part).parquet(f"{sink.rstrip('/')}/batch={epoch}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Seen keys live here: state on local disk with its changes in the checkpoint, so it may exceed memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_reviews(spark: SparkSession, landing: str, schema, sink: str, checkpoint: str,
                   max_files: int | None = None):
    """ST1: start the ingest stream; returns the ``StreamingQuery`` (``availableNow`` trigger).

    A review is kept once per ``(source, review_id)``: the keys seen so far are the query's state, partitioned
    by key and versioned in ``checkpoint``, without a watermark. So a micro-batch reads its own files only,
    however large the sink is; how files fall into micro-batches, how late a review lands and restarts change
    nothing. Of copies that land in one micro-batch any one is kept. Null sources or ids are keys like others.
    The sink is partitioned by batch and ISO week; read it with ``load_stream``. It belongs to its checkpoint:
    a sink that exists without one is refused, as its keys would be unknown."""
    if path_exists(spark, sink) and not path_exists(spark, checkpoint):
        raise ValueError(f"{sink} exists but its checkpoint {checkpoint} does not: the keys it holds are unknown")
    src = spark.readStream.schema(schema)
    if max_files:
        src = src.option("maxFilesPerTrigger", max_files)
    s = src.parquet(landing).dropDuplicates(["source", "review_id"]).withColumn("content", scrub_pii("content"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)       # a query keeps the settings it starts with
    try:
        return (s.writeStream.foreachBatch(lambda b, epoch: append_batch(b, epoch, sink, "iso_week"))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)


def load_stream(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows of an ST1 sink."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(sink).drop("batch")


def upsert_partitions(batch: DataFrame, table: str, keys: list[str], part: str) -> None:
    """Keyed upsert into a Parquet table partitioned by ``part``: only the partitions this batch
    touches are read (partition pruning), merged (the batch's rows win) and rewritten with dynamic
    partition overwrite. The merge is staged first, so no file is overwritten while being read.
    Idempotent, so a replayed micro-batch gives the same table."""
    from themelens.session import stage
    spark = batch.sparkSession
    batch = stage(batch, "upsert-batch")
    merged = batch
    if path_exists(spark, table):
        old = spark.read.schema(batch.schema).parquet(table)
        touched = batch.select(part).distinct()
        old = old.join(touched, part, "left_semi").join(batch.select(*keys), keys, "left_anti")
        merged = stage(old.unionByName(batch), "upsert-merged")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(part).parquet(table))


def weekly_counts_stream(spark: SparkSession, landing: str, schema, table_root: str, checkpoint: str,
                         ts_col: str = "ts", product_col: str = "event_type", value_col: str = "value",
                         watermark: str = "7 days"):
    """ST2: reviews (events) and mean rating (value) per product and ISO week; rows later than the
    watermark are dropped. Each micro-batch is upserted into the Parquet table at ``table_root``,
    partitioned by week. Returns the ``StreamingQuery``."""
    tz = _tz(spark)
    s = (spark.readStream.schema(schema).parquet(landing)
              .withColumn("event_ts", ntz_as_instant(F.col(ts_col), tz))
              .withWatermark("event_ts", watermark)
              .groupBy(F.window("event_ts", "7 days", "7 days", "4 days").alias("w"), F.col(product_col))
              .agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("avg_value"))
              .select(instant_as_ntz(F.col("w.start"), tz).alias("week_start"), product_col, "n", "avg_value")
              # partition by the week as text: a timestamp partition value would pass through the
              # session time zone on its way to and from the directory name
              .withColumn("week", F.date_format("week_start", "yyyy-MM-dd")))
    keys = ["week_start", product_col]
    q = (s.writeStream.foreachBatch(lambda b, _epoch: upsert_partitions(b, table_root, keys, "week"))
          .option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start())
    return q


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's landing zone, sink or checkpoint, inside the shared
    checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
