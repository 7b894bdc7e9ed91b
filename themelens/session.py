"""Session construction and the few cluster-level settings operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "themelens", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow on. ``shuffle_partitions`` is set only if it is given, so a
    cluster's own setting stands (rule of thumb: input bytes / 128 MB); tests pass a small number."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the setting is unset *and* the master is local (tests, the bench) do we pick a fresh
    scratch folder; on a cluster an unset checkpoint dir is a configuration error, because a
    machine-local folder does not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:       # Spark Connect: no context; the setting must name the shared folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="themelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before running "
                       "iterative operators")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Use where several branches of a plan read the same expensive intermediate (the scrubbed review
    table): the regex work runs once, later scans are columnar and prune columns, and the lineage
    restarts here if an executor is lost. The shuffle files of the write go when it has ended, since nothing
    reads them again; Spark keeps them otherwise until the driver happens to collect its garbage."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)     # known schema: no footer scan


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it, so that no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_STAGED: list[str] = []        # paths this process has staged and not yet dropped


def drop_staged(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads: the given ones, or all of this process. Call it
    when the results built on them have been written."""
    files = [f for t in tables for f in t.inputFiles()]
    gone = [p for p in _STAGED if not tables or any(p.rsplit("/", 1)[-1] in f for f in files)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _STAGED.remove(p)


#: A scan of fewer partitions than this (at most so many times ``maxPartitionBytes``) may be spread.
SMALL_SCAN = 8


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread the scan of a small file with few row groups, so the CPU-heavy text work uses every core.
    Only a scan of fewer than ``SMALL_SCAN`` partitions is shuffled, whatever the size of the cluster, so
    at most about a gigabyte moves; larger tables keep their scan. Results do not depend on it."""
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:       # a session without RDD access (Spark Connect): leave the scan as it is
        return df
    return df.repartition(want) if have < min(want, SMALL_SCAN) else df


#: Written bytes (compressed Parquet) up to which a checked table may be broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def written_bytes(spark: SparkSession, staged: DataFrame) -> int:
    """Bytes of a staged table's files, whatever file system they are in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for f in staged.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def is_small(staged: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table is within both limits: bytes on disk, then rows."""
    return written_bytes(staged.sparkSession, staged) <= max_bytes and staged.count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking its rows and bytes; beyond either limit the join stays a shuffle
    join (AQE may still broadcast it at run time). ``df`` is written once to the shared folder first, so the
    check and the join read the same copy instead of computing it twice."""
    from pyspark.sql import functions as F
    staged = stage(df, "small-side")
    return F.broadcast(staged) if is_small(staged, max_rows, max_bytes) else staged
