"""Shared-folder plumbing: where intermediates live and how workers find this package.

Driver and executors share only ``spark.checkpoint.dir`` (and the warehouse), so every
table that cuts lineage and every binary file goes below that folder.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches of long texts small.

    The bound is on rows, as Spark has it: 1,000 texts of the usual few kilobytes are a few megabytes.  It is a
    setting of the session (plans read it when they run, so it cannot be put back), and never raised.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, a laptop) a folder below the local temp folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = os.path.join(tempfile.gettempdir(), "tidewheel-shared")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the application ends.

    Operators delete what they no longer need themselves; the rest is read by lazy results until then.
    """
    root = f"{shared_dir(spark).rstrip('/')}/tidewheel/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`materialise` returned."""
    files = df.inputFiles()
    if files:
        drop(df.sparkSession, os.path.dirname(files[0]))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
