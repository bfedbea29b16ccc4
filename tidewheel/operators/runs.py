"""Whole runs: ordered steps that stop at a failure, the manifest of a build, the rolling window."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidewheel.functions import scalars as S
from tidewheel.sources import versions


def run_all(spark: SparkSession, steps: list[tuple[str, Callable[[], DataFrame]]], skip: tuple[str, ...] = (), write: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Run named steps in order: (step, name, status, n_rows, message); the first failure ends the run, its message is kept.

    A step builds its frame lazily; it is written by ``write`` (name, frame) and its rows are counted on the way, or it is only
    counted: computed once either way.  ``skip`` names steps whose results are there already (the download, say); a name that is no step raises before anything runs.
    """
    if unknown := set(skip) - {name for name, _ in steps}:
        raise ValueError(f"no such step: {sorted(unknown)}")
    rows, failed = [], False
    for number, (name, build) in enumerate(steps, 1):
        status, n, message = "not run" if failed else "skipped" if name in skip else "done", None, None
        if status == "done":
            try:
                frame = build()
                if write is not None:
                    seen = Observation()
                    write(name, frame.observe(seen, F.count(F.lit(1)).alias("n")))
                    n = seen.get["n"]
                else:
                    n = frame.count()
            except Exception as e:  # noqa: BLE001  whatever a step raises is its failure
                status, failed, message = "failed", True, f"{type(e).__name__}: {e}"
        rows.append((number, name, status, n, message))
    return spark.createDataFrame(rows, "step int, name string, status string, n_rows long, message string")


def manifest(daily: DataFrame) -> DataFrame:
    """One row about a build: its months, stations with any month and with all of them."""
    rows = daily.select("station_id", S.month_key("date").alias("month")).distinct()
    months = rows.agg(F.array_sort(F.collect_set("month")).alias("months"))
    each = rows.groupBy("station_id").agg(F.count("*").alias("n")).join(F.broadcast(months))  # one row
    return each.groupBy("months").agg(F.count("*").alias("n_any"), F.count_if(F.col("n") == F.size("months")).alias("n_full"))


def roll_window(spark: SparkSession, path: str, new: DataFrame) -> list[str]:
    """A versioned daily table takes the months of ``new``, and as many of its oldest ones go, in one step.  Returns its months.

    See :mod:`tidewheel.sources.versions`: a run that is killed leaves the old table, readers keep the version they opened.
    """
    versions.change(spark, path, new, lambda have, fresh: [m for m in have if m not in fresh][: len(fresh)])
    return list(versions.current(spark, path)[1])
