"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(cores: int | str = "*", app: str = "basketry", shuffle_partitions: int | None = None,
              checkpoint_dir: str | None = None) -> SparkSession:
    """Local session used by the bench and by hand (a cluster passes its own session). Written tables go to
    ``checkpoint_dir``, or to a new temporary folder, which a local master shares with nobody."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores)) or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only on measured size: static file-size guesses are off for joined or
        # compressed inputs, so the planner starts from sort-merge joins and AQE switches a side
        # to broadcast once its shuffle stage reports fewer bytes than the adaptive threshold.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(CHECKPOINT_CONF, checkpoint_dir or tempfile.mkdtemp(prefix="basketry-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``DataFrame.checkpoint`` at the shared folder named by ``spark.checkpoint.dir``.

    A cluster names that folder in its configuration and we only read it. When it is unset we
    create a temporary folder, but only for a local master (tests, bench); on a cluster an
    unset value is an error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running iterative operators")
        path = tempfile.mkdtemp(prefix="basketry-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table under ``spark.checkpoint.dir`` and read it back.

    For tables that many later steps reuse (cleaned lines, the per-customer table): it cuts the
    lineage, so a lost executor re-reads the written table instead of recomputing from raw lines,
    and the copy is columnar, compressed, prunable and carries real size statistics for the
    planner's broadcast decisions. Faster to write and read than a serialised RDD checkpoint.
    """
    spark = df.sparkSession
    path = f"{_tables_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer-reading job


#: Sizes of shuffled and of scanned data per task while wide rows are written, where the session has larger ones.
_SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20, "spark.sql.files.maxPartitionBytes": 32 << 20}


@contextlib.contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Tasks of a write inside hold less data each; the session's own settings come back afterwards.

    Both sizes are of compressed data, and cleaned lines take some twenty times as much in memory, where a write sorts
    them by folder and a summary hashes them.
    """
    before = {key: spark.conf.get(key) for key in _SMALL}
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for key, most in _SMALL.items():
            if bytes_of(before[key]) > most:
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextlib.contextmanager
def subset_keys(spark: SparkSession) -> Iterator[None]:
    """Joins inside take rows dealt by some of their keys as they are; the session's own setting comes back afterwards."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        yield
    finally:
        spark.conf.set(key, before)


def table_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application, beside those of ``materialize`` and dropped with them."""
    return f"{_tables_root(spark)}/{name}"


def _tables_root(spark: SparkSession) -> str:
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def drop_materialized(spark: SparkSession) -> bool:
    """Delete every table ``materialize`` wrote for this application (call when the DataFrames
    built on them are no longer needed, e.g. at the end of a job or a dashboard session).
    Uses the Hadoop FileSystem of the checkpoint folder, so it works on any shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True)) if fs.exists(path) else False


def release(df: DataFrame) -> bool:
    """Delete the one table behind a DataFrame returned by ``materialize``."""
    spark = df.sparkSession
    files = df.inputFiles()
    root = _tables_root(spark)
    if not files:
        return False
    table_dir = files[0].rsplit("/", 1)[0]
    if root.removeprefix("file:").rstrip("/") not in table_dir:
        raise ValueError("not a table written by materialize()")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
