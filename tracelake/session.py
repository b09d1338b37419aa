"""Session settings shared by jobs, tests and the bench.

Jobs never create their own cluster settings; they only make sure the few
SQL settings the span queries depend on are present on whatever session they
are handed (UTC session time, AQE with skew-join splitting).
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every span job relies on. All are runtime SQL confs, so they can be
# applied to an existing session (e.g. the one a driver hands us).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parquet written by the layout jobs: zstd, as the reference table codec.
    "spark.sql.parquet.compression.codec": "zstd",
    # VARIANT attributes: frequent keys become Parquet columns of their own, and a path that a query takes is
    # pushed into the scan, which then reads that column alone.
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the span queries need; idempotent."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tracelake", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TRACELAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system); without it executors could not see each other's files, so the call
    fails. Only on a local master (one machine) does an unset folder mean a fresh
    scratch folder, recorded in the session so that every later call sees the same one.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tracelake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared checkpoint folder for one job output."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a job's own working table, once what it was written for is done."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move_files(spark: SparkSession, source: str, folder: str) -> None:
    """Move the data files of a written table into ``folder``. They are as new there as they arrive: file streams take files by their time."""
    import time

    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs, to = hadoop(source).getFileSystem(conf), hadoop(folder)
    fs.mkdirs(to)
    for status in fs.listStatus(hadoop(source)):
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        moved = hadoop(to, name)
        if not fs.rename(status.getPath(), moved):
            raise OSError(f"{status.getPath().toString()} can't be moved to {folder}")
        try:
            fs.setTimes(moved, int(time.time() * 1000), -1)
        except Exception as e:  # stores without it give a moved file its time anew
            if "UnsupportedOperation" not in str(e):
                raise


def ship_code(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python workers, once a context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_tracelake_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tracelake-"), "tracelake.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tracelake", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tracelake_shipped = True
    return spark
