"""Net flow, throughput, daily components and hour-of-day curves.

Null station ids and names never form a group.  Hours without a trip have no row; only 24-value
curves fill them with 0.0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators.quality import canonical_map

HOURS = list(range(24))


def side(trips: DataFrame, arrivals: bool) -> DataFrame:
    """One end of each trip whose station is known, with sign +1 (arrival) or -1 (departure)."""
    end, at = ("end", "ended_at") if arrivals else ("start", "started_at")
    return trips.filter(F.col(f"{end}_station_id").isNotNull()).select(
        F.col(f"{end}_station_id").alias("station_id"), F.col(f"{end}_station_name").alias("station_name"), F.col(at).alias("moment"),
        F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lng").alias("lng"), F.lit(1 if arrivals else -1).cast("long").alias("sign"))


def sides(trips: DataFrame) -> DataFrame:
    both = side(trips, True).unionByName(side(trips, False))
    return both.withColumns({"month": S.month_key("moment"), "day_type": S.day_type("moment"), "date": F.to_date("moment"), "hour": F.hour("moment")})


def days_per_bucket(trips: DataFrame) -> DataFrame:
    """Distinct dates per (month, day_type) over start and end dates of all trips."""
    dates = trips.select(F.explode(F.array(F.to_date("started_at"), F.to_date("ended_at"))).alias("date")).filter("date IS NOT NULL")
    return dates.groupBy(S.month_key("date").alias("month"), S.day_type("date").alias("day_type")).agg(F.countDistinct("date").alias("n_days"))


def side_monthly(trips: DataFrame, arrivals: bool | None = None) -> DataFrame:
    """Signed counts and median places per side, station, name, month, day type and hour."""
    keys = ["sign", "station_id", "station_name", "month", "day_type", "hour"]
    rows = sides(trips).filter("station_name IS NOT NULL")
    if arrivals is not None:
        rows = rows.filter(F.col("sign") == (1 if arrivals else -1))
    return rows.groupBy(*keys).agg(F.sum("sign").alias("net"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))


def side_daily(trips: DataFrame, arrivals: bool | None = None) -> DataFrame:
    keys = ["sign", "station_id", "station_name", "date", "hour"]
    rows = sides(trips).filter("station_name IS NOT NULL")
    if arrivals is not None:
        rows = rows.filter(F.col("sign") == (1 if arrivals else -1))
    return rows.groupBy(*keys).agg(F.sum("sign").alias("net"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))


def per_day(total, days) -> Column:
    return F.bround(S.col(total) / F.greatest(S.col(days), F.lit(1)), 3)


def net_flow(trips: DataFrame) -> DataFrame:
    """Monthly net flow; places are the medians of the two sides' medians."""
    keys = ["station_id", "station_name", "month", "day_type", "hour"]
    net = side_monthly(trips).groupBy(*keys).agg(F.sum("net").alias("net"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    return net.join(F.broadcast(days_per_bucket(trips)), ["month", "day_type"], "left").withColumn("net_per_day", per_day("net", "n_days"))  # two rows a month


def throughput(trips: DataFrame) -> DataFrame:
    total = sides(trips).groupBy("station_id", "month", "day_type", "hour").agg(F.count("*").alias("count"))
    return total.join(F.broadcast(days_per_bucket(trips)), ["month", "day_type"], "left").withColumn("throughput_per_day", per_day("count", "n_days"))  # two rows a month


def daily_net(trips: DataFrame) -> DataFrame:
    keys = ["station_id", "station_name", "date", "hour"]
    return side_daily(trips).groupBy(*keys).agg(F.sum("net").alias("net"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))


def daily_components(trips: DataFrame) -> DataFrame:
    """Arrivals and departures side by side in one aggregation; places from the arrival side first."""
    keys = ["station_id", "station_name", "date", "hour"]
    by = side_daily(trips).withColumn("in", F.col("sign") > 0)
    at = lambda c, f: F.max(F.when(F.col("in") == f, F.col(c)))  # noqa: E731  one row per side
    out = by.groupBy(*keys).agg(
        F.coalesce(at("net", True), F.lit(0)).cast("long").alias("arrivals_count"), F.coalesce(-at("net", False), F.lit(0)).cast("long").alias("departures_count"),
        F.coalesce(at("lat", True), at("lat", False)).alias("lat"), F.coalesce(at("lng", True), at("lng", False)).alias("lng"))
    return out.withColumn("net", F.col("arrivals_count") - F.col("departures_count"))


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    """The monthly frame rebuilt from a daily table (station_id, station_name, date, hour, net, lat, lng)."""
    rows = daily.filter("station_id IS NOT NULL AND station_name IS NOT NULL").withColumns({"month": S.month_key("date"), "day_type": S.day_type("date")})
    keys = ["station_id", "station_name", "month", "day_type", "hour"]
    net = rows.groupBy(*keys).agg(F.sum("net").alias("net"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    days = rows.groupBy("month", "day_type").agg(F.countDistinct("date").alias("n_days"))
    return net.join(F.broadcast(days), ["month", "day_type"], "left").withColumn("net_per_day", per_day("net", "n_days"))  # two rows a month


def curve_points(monthly: DataFrame) -> DataFrame:
    """Weighted mean flow by hour at all-period, seasonal and monthly grain in one grouping-sets pass.

    Sums are of whole thousandths, so their order decides no rounding.
    """
    rows = monthly.withColumns({"season": S.season("month"), "w": F.bround(F.col("net_per_day") * 1000, 0).cast("long") * F.col("n_days")})
    sets = rows.groupingSets(
        [[F.col("station_id"), F.col("day_type"), F.col("hour")], [F.col("station_id"), F.col("day_type"), F.col("hour"), F.col("season")], [F.col("station_id"), F.col("day_type"), F.col("hour"), F.col("month")]],
        "station_id", "day_type", "hour", "season", "month").agg((F.bround(F.sum("w") / F.sum("n_days"), 0) / 1000).alias("value"))
    grain = F.when(F.col("month").isNotNull(), "month").when(F.col("season").isNotNull(), "season").otherwise("all")
    return sets.select("station_id", grain.alias("grain"), F.coalesce("month", "season", F.lit("all")).alias("period"), "day_type", "hour", "value")


def curves(points: DataFrame, *keys: str) -> DataFrame:
    """24-value arrays; an hour without a point is 0.0."""
    cells = [F.coalesce(F.max(F.when(F.col("hour") == h, F.col("value"))), F.lit(0.0)) for h in HOURS]
    return points.groupBy(*(keys or ("station_id", "grain", "period", "day_type"))).agg(F.array(*cells).alias("curve"))


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("station_id").agg(F.array_sort(F.collect_set("month")).alias("months")).withColumn("n_months", F.size("months"))


def repair(daily: DataFrame, months: list[str]) -> DataFrame:
    """Daily rows of a window with split ids merged: counts summed, name and place from the canonical id's own rows."""
    rows = daily.filter(S.month_key("date").isin(months))
    names = canonical_map(rows, "station_id")
    own = rows.groupBy("station_id").agg(F.mode("station_name", True).alias("station_name"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    moved = rows.join(names.withColumnRenamed("id", "station_id"), "station_id", "left").withColumn("station_id", F.coalesce("canonical", "station_id"))
    total = moved.groupBy("station_id", "date", "hour").agg(*(F.sum(c).alias(c) for c in ("arrivals_count", "departures_count", "net")))
    return total.join(own, "station_id", "left")


def replace_months(old: DataFrame, new: DataFrame, dropped: list[str]) -> DataFrame:
    """The rolling window: months leave, a newly built one joins."""
    return old.filter(~S.month_key("date").isin(dropped)).unionByName(new)
