"""One place for session settings: UTC, adaptive execution, partitions by cores."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators instead."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName("tidewheel")
        .config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a source folder (a cluster installs it)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset (tests)."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or os.path.join(tempfile.gettempdir(), "tidewheel-shared")


def cut(df):
    """``df`` computed once and kept in the checkpoint folder: lineage ends here, and a lost executor costs no recomputing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def at_once(jobs: list, threads: int = 8) -> list:
    """Results of calls that each start small Spark jobs, run side by side in the order given."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
