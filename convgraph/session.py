"""Session helpers.

The library never mutates a caller's session except for the checkpoint
directory, and only when the cluster has not named one
(``spark.checkpoint.dir``).  Tests and ``bench.py`` build their own local
session through :func:`local_session`.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "convgraph") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CONVGRAPH_DRIVER_MEM", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared directory for lineage cuts.

    Reads ``spark.checkpoint.dir`` (the cluster's shared folder).  Only when
    it is unset -- local tests -- a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        # a machine-local folder is not shared by the executors of a cluster
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for iterative jobs")
    path = tempfile.mkdtemp(prefix="convgraph-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for files that a job writes and reads
    back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/convgraph-{label}-{uuid.uuid4().hex}"


def cut_lineage(df, replaces=None):
    """Cut lineage by writing the rows to the shared checkpoint folder as
    Parquet and reading them back.

    Survives executor loss (unlike ``localCheckpoint``), bounds the plan of
    iterative jobs, and -- unlike ``Dataset.checkpoint`` -- carries no
    accumulated plan metadata from earlier rounds into the next one, so
    planning time stays flat over hundreds of rounds.  ``replaces`` names an
    earlier cut that the new one supersedes; its folder is deleted once the
    new rows are written, so an iterative job keeps one or two rounds on
    storage instead of all of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._cut_path = path
    if replaces is not None:
        release(replaces)
    return out


def release(df) -> None:
    """Delete the storage behind a DataFrame returned by ``cut_lineage``
    (no-op for anything else).  Only call it when nothing still reads it."""
    path = getattr(df, "_cut_path", None)
    if not path:
        return
    try:  # clean-up is best effort: a failure here must not fail the job
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose frames are gone.  It
    does so when the driver collects garbage, which a driver with a large heap
    may not do for many rounds of an iterative job."""
    spark.sparkContext._jvm.System.gc()


def pickle_by_value(module_name: str) -> None:
    """Ship a module's Python UDF code to the workers inside the task
    closures (cloudpickle by value), so executors need no installed copy of
    the package and no PYTHONPATH set up by the caller."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except (ImportError, AttributeError, KeyError, ValueError):
        pass
