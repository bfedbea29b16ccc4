"""Streaming forms of the availability metrics; each equals its batch form on the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel import constants as C
from tidewheel.operators import availability as A
from tidewheel.sources import files

PERSISTED = "station_id long, observed_at timestamp, next_at timestamp, still boolean"


def ingest(status: DataFrame, information: DataFrame) -> DataFrame:
    """Stream-static crosswalk join with the UTC day that files are laid out by."""
    cap = information.select("feed_id", "station_id")
    return status.join(F.broadcast(cap) if not cap.isStreaming else cap, "feed_id").withColumn("utc_date", F.to_date("timestamp"))  # a city's stations


def unusable_rate(snapshots: DataFrame, window: str = "1 day", late: str = "2 hours", column: str = "observed_at") -> DataFrame:
    """Unusable rate per tumbling window; append mode withholds the window still open at the watermark."""
    t = A.tag(snapshots.withColumn(column, F.col(column).cast("timestamp"))).filter("is_online")
    if snapshots.isStreaming:
        t = t.withWatermark(column, late)
    g = t.groupBy(F.window(column, window)).agg(F.count("*").alias("n_online"), F.count_if("unusable").alias("n_unusable"))
    return g.select(F.col("window.start").alias("start"), "n_online", "n_unusable", (F.col("n_unusable") / F.col("n_online")).alias("unusable_rate"))


def persistence(snapshots: DataFrame, minutes: int = C.PERSISTENCE_MINUTES, late: str = "2 hours", column: str = "observed_at") -> DataFrame:
    """Per online unusable reading: the station's next online reading within ``minutes`` and whether it is still unusable.

    Readings may come in any order within the watermark: a station's state is its sorted readings from the watermark on,
    and the last one before it.  A pair is given out when the watermark has passed its later reading, so the result
    equals the batch one whatever the order and the batches; a reading's pair waits until then, at most ``late``.
    Readings later than the watermark are dropped.  State leaves when nothing can follow its last reading in time.
    """
    t = A.tag(snapshots.withColumn(column, F.col(column).cast("timestamp"))).filter("is_online").withWatermark(column, late)
    t = t.select("station_id", F.col(column).alias("at"), "event_id", "unusable")
    horizon = minutes * 60_000_000

    def step(key, frames, state: GroupState):
        import pandas as pd

        mark = state.getCurrentWatermarkMs() * 1000
        held = list(zip(*state.get)) if state.exists else []
        if not state.hasTimedOut:
            for pdf in frames:
                held += [(int(a.value // 1000), int(e), bool(u)) for a, e, u in zip(pdf["at"], pdf["event_id"], pdf["unusable"])]
        held.sort()
        sure = sum(at < mark for at, _, _ in held)  # nothing can come between these any more
        out = [(int(key[0]), pd.Timestamp(a[0], unit="us"), pd.Timestamp(b[0], unit="us"), b[2]) for a, b in zip(held[:sure], held[1:sure]) if a[2] and b[0] - a[0] <= horizon]
        unsure, held = held[sure:], held[max(sure - 1, 0) :]
        if len(held) == 1 and held[0][0] + horizon < mark:
            state.remove()
        elif held:
            state.update(tuple(map(list, zip(*held))))
            wake = unsure[0][0] if unsure else held[0][0] + horizon
            state.setTimeoutTimestamp(max(wake // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["station_id", "observed_at", "next_at", "still"])

    return t.groupBy("station_id").applyInPandasWithState(step, PERSISTED, "at array<long>, event array<long>, unusable array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_latest(path: str):
    """A ``foreachBatch`` writer that keeps each station's last reading in a table: version ``n`` below ``path`` is of the batches up to ``n``.

    A version is the one before it merged with the batch, so a repeated batch writes the same again, and nothing is
    kept in the driver.  The version before last is deleted.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/version={n - 1}"
        if files.exists(spark, f"{before}/_SUCCESS"):
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(before))
        last = F.max_by(F.struct(*batch.columns), F.struct("observed_at", "event_id"))
        batch.groupBy("station_id").agg(last.alias("s")).select("s.*").write.mode("overwrite").parquet(f"{path}/version={n}")
        files.delete(spark, f"{path}/version={n - 2}")

    return write


def read_latest(spark, path: str, schema) -> DataFrame:
    """The newest whole version; an empty frame if there is none."""
    whole = [int(v) for v in files.partitions(spark, path, "version") if files.exists(spark, f"{path}/version={v}/_SUCCESS")]
    return spark.read.schema(schema).parquet(f"{path}/version={max(whole)}") if whole else spark.createDataFrame([], schema)
