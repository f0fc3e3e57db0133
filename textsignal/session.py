"""Spark session defaults used by tests, the bench and the examples.

On a cluster the session is created by the platform; ``ensure_checkpoint_dir``
then only *reads* ``spark.checkpoint.dir``.  A local scratch directory is set
only when the session runs in local mode and nothing is configured.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_spark(cpus: int | str | None = None, shuffle_partitions: int | None = None,
              app: str = "textsignal", driver_memory: str = "16g") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per context), so that Python functions of the
    operators import it wherever the session was started."""
    sc = spark.sparkContext
    if getattr(sc, "_textsignal_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="textsignal-"), "textsignal.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._textsignal_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only locally."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="textsignal-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut the lineage of a small intermediate that several branches reuse: a reliable
    ``checkpoint`` into the session's shared checkpoint folder (survives executor loss;
    never ``localCheckpoint``)."""
    try:
        ensure_checkpoint_dir(df.sparkSession)
    except RuntimeError:   # a cluster without a shared checkpoint folder: keep lineage, persist
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.checkpoint(eager=True)
