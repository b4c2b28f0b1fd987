"""Session construction and cluster-wide settings.

Every operator in this package is a function from DataFrames to a DataFrame;
the session only carries configuration.  The settings below are the ones the
operators rely on for their plans at scale:

* AQE on, with skew-join splitting and partition coalescing, so hot keys and
  hot spatial cells are split at runtime and tiny shuffles collapse.
* an explicit runtime broadcast threshold: AQE turns a join into a broadcast
  after it has *measured* the materialized side; before that, only a side whose
  files are small (``PLANNED_BROADCAST_BYTES``) is planned as one.  Otherwise
  the sort-merge plan stays.
* UTC session time zone, so hour extraction and date casts are the same on
  every executor and in the DuckDB oracle.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime broadcast limit (bytes of the measured, materialized side).
BROADCAST_BYTES = 64 * 1024 * 1024
# Planning limit (bytes of a side as its files or statistics say).
PLANNED_BROADCAST_BYTES = 10 * 1024 * 1024


def build_session(
    master: str | None = None,
    app_name: str = "tern",
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect.

    On a cluster, ``master`` is left unset and comes from spark-submit.
    ``shuffle_partitions`` defaults to 2x the local cores in local mode; on a
    cluster AQE coalesces from whatever the deployment sets.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    if master and master.startswith("local["):
        spec = master[len("local[") : -1]
        cores = cores if spec == "*" else int(spec)
    parts = shuffle_partitions or max(8, 2 * cores)
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
        "spark.sql.autoBroadcastJoinThreshold": str(PLANNED_BROADCAST_BYTES),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.driver.memory": driver_memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.ansi.enabled": "true",
        # checkpoint files of DataFrames that went out of scope are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Let the JIT compile large generated methods (the exact spatial
        # tests make big fused stages); HotSpot otherwise interprets any
        # method above 8000 bytes of bytecode.
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and durable intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster names it.  Only when it
    is unset on a local master (tests) a fresh directory is created and
    registered; on a cluster an unset folder is an error, because a
    driver-local one is not visible to the executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="tern-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table below the shared folder."""
    return f"{checkpoint_dir(spark)}/tern/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but later reads prune columns,
    push filters down, scan vectorized and know the table's size.  The files
    survive lost executors.  They stay until the shared folder is cleaned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; the former ones return."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``materialize``d table that nothing reads any more
    (steps of an iteration, say).  Tables elsewhere are left alone."""
    spark = df.sparkSession
    home = f"{checkpoint_dir(spark)}/tern/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        ours = system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(home)).toUri().getPath()
        if path.toUri().getPath().startswith(ours.rstrip("/") + "/"):
            system.delete(path, True)
