"""Availability log: unusable rates weighted by observations, sampling gaps, persistence, live status."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel import constants as C
from tidewheel.operators.ordered import ordered, quantile


def tag(snapshots: DataFrame) -> DataFrame:
    """is_online: renting and returning; unusable: no bikes or no docks."""
    online = (F.col("is_renting") == 1) & (F.col("is_returning") == 1)
    return snapshots.withColumns({
        "is_online": F.coalesce(online, F.lit(False)), "is_empty": F.coalesce(F.col("bikes_available") == 0, F.lit(False)),
        "is_full": F.coalesce(F.col("docks_available") == 0, F.lit(False))}).withColumn("unusable", F.col("is_empty") | F.col("is_full"))


def system(snapshots: DataFrame) -> DataFrame:
    t, n = tag(snapshots), F.count_if
    on = F.col("is_online")
    out = t.agg(n(on).alias("n_online"), n(on & F.col("unusable")).alias("n_unusable"), n(on & F.col("is_empty")).alias("n_empty"),
                n(on & F.col("is_full")).alias("n_full"), n(~on).alias("n_offline"))
    return out.withColumn("unusable_rate", F.try_divide(F.col("n_unusable").cast("double"), F.col("n_online")))


def by_station(snapshots: DataFrame) -> DataFrame:
    t = tag(snapshots).filter("is_online").groupBy("station_id")
    return t.agg(F.count("*").alias("n_observations"), F.count_if("unusable").alias("n_unusable")).withColumn("unusable_rate", F.col("n_unusable") / F.col("n_observations"))


def summary(snapshots: DataFrame, floor: int = C.RANKABLE) -> DataFrame:
    rate = F.when(F.col("n_observations") >= floor, F.col("unusable_rate"))
    stations = by_station(snapshots)
    out = stations.agg(F.count("*").alias("n_stations"), F.count(rate).alias("n_rankable"), F.max(rate).alias("max_rate"))
    return out.join(quantile(stations, rate, 0.5, name="median_rate")).select("n_stations", "n_rankable", "median_rate", "max_rate")  # one-row frames


def gaps(snapshots: DataFrame, column: str = "observed_at") -> DataFrame:
    """(start, end, minutes) between consecutive distinct snapshot times, offline rows included."""
    times = snapshots.select(F.col(column).alias("start")).filter("start IS NOT NULL").distinct()
    nxt = ordered(times, ["start"], nexts={"end": "start"}).filter("end IS NOT NULL")
    return nxt.withColumn("minutes", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / F.lit(60e6))


def window(snapshots: DataFrame, column: str = "observed_at") -> DataFrame:
    each = gaps(snapshots, column)
    g = each.agg(F.max("minutes").alias("max_gap_min"),
                                    F.max_by("start", F.struct(F.col("minutes"), -F.unix_micros(F.col("start").cast("timestamp")))).alias("longest_gap_start"))
    t = snapshots.agg(F.min(column).alias("first_at"), F.max(column).alias("last_at"), F.countDistinct(column).alias("n_snapshots"), F.countDistinct(F.to_date(column)).alias("n_days_with_data"))
    t = t.withColumn("span_days", F.datediff(F.to_date("last_at"), F.to_date("first_at")) + 1)
    return t.join(g).join(quantile(each, "minutes", 0.5, name="median_gap_min"))  # one-row frames


def persistence(snapshots: DataFrame, minutes: int = C.PERSISTENCE_MINUTES) -> DataFrame:
    """Of online unusable readings with a next online reading of the station within ``minutes``, how many are still unusable."""
    order = W.partitionBy("station_id").orderBy("observed_at", "event_id")
    t = tag(snapshots).filter("is_online").withColumns({"next_at": F.lead("observed_at").over(order), "next_unusable": F.lead("unusable").over(order)})
    gap = (F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / F.lit(60e6)
    t = t.filter(F.col("unusable") & (gap <= minutes))
    return t.agg(F.count("*").alias("n_with_next"), F.count_if("next_unusable").alias("n_still")).withColumn("share", F.try_divide(F.col("n_still").cast("double"), F.col("n_with_next")))


def live_status(status: DataFrame, information: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per matched station, one row with the number dropped) of two feeds joined by feed id."""
    cap = information.select("feed_id", "station_id", F.coalesce("capacity", F.lit(0)).cast("long").alias("capacity"))
    live = status.join(cap, "feed_id").select("station_id", "capacity", "bikes_available", "docks_available",
                                              (F.col("is_renting") == 1).alias("is_renting"), (F.col("is_returning") == 1).alias("is_returning"))
    return live, status.join(cap, "feed_id", "left_anti").agg(F.count("*").alias("n_dropped"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last reading of each station."""
    last = F.max_by(F.struct("observed_at", "bikes_available", "docks_available", "is_renting", "is_returning"), F.struct("observed_at", "event_id"))
    return snapshots.groupBy("station_id").agg(last.alias("s")).select("station_id", "s.*")
