"""Elasticities of flow: to weather and to capacity, by typology and by station.

``roster``: one row a station with cluster_name, magnitude (mean absolute weekday flow by hour), capacity and throughput
(null or zero where unknown).  ``panel``: station_id, date, magnitude, temp_mean_c, precip_mm, a row a station and day.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.operators import stats
from tidewheel.session import cut

NAMED = ("Commuter core (fills AM, drains PM)", "Residential feeder (drains AM, fills PM)", "Mixed/flat rhythm", "Flat (no rhythm)")
WEATHER = "temp_elasticity double, temp_low double, temp_high double, precip_elasticity double, precip_low double, precip_high double"


def capacity_curve(roster: DataFrame) -> dict | None:
    """Magnitude on capacity, its square and throughput; None with fewer than ``MIN_CAPACITIES`` capacities or a deficient rank."""
    rows = roster.filter("capacity > 0 AND throughput IS NOT NULL").withColumn("capacity2", F.col("capacity").cast("double") * F.col("capacity"))
    if rows.select("capacity").distinct().count() < C.MIN_CAPACITIES:
        return None
    return stats.ols(rows, "magnitude", ["capacity", "capacity2", "throughput"])


def _weather(fits: DataFrame, key: str, days: Column, magnitude: Column) -> DataFrame:
    """Elasticities and bounds of every key; null where there are too few days or no fit."""
    out, magnitude = [F.col(key)], F.nullif(magnitude, F.lit(0.0))
    for name, b, se in (("temp", "b1", "se1"), ("precip", "b2", "se2")):
        ok = (days >= C.MIN_DAYS) & F.col(b).isNotNull()
        low, high = stats.ci95(F.col(b), F.col(se), magnitude)
        out += [F.when(ok, v).alias(f"{name}_{c}") for c, v in (("elasticity", F.bround(F.col(b) / magnitude, 4)), ("low", low), ("high", high))]
    return fits.select(*out)


def _at(curve: dict, capacity, magnitude) -> tuple[Column, Column, Column]:
    """Capacity elasticity of a fitted curve at a capacity, and its bounds."""
    b, v, magnitude = curve["beta"], curve["cov"], F.nullif(magnitude, F.lit(0.0))
    slope = stats.local_slope(F.lit(float(b[1])), F.lit(float(b[2])), capacity)
    se = stats.local_slope_se(F.lit(float(v[1, 1])), F.lit(float(v[2, 2])), F.lit(float(v[1, 2])), capacity)
    return F.bround(slope / magnitude, 4), *stats.ci95(slope, se, magnitude)


def elasticities(roster: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by typology, by station).  Stations of no named type have no row, nor stations of zero magnitude by station.

    A station's capacity elasticity is its type's curve at its own capacity; it is null where the type has no curve
    or the station no capacity.  ``rank_correlation`` is between the stations' capacities and these, ``ceiling`` whether it
    shows that capacity bounds the flow.  The types are four, so their curves are fitted one by one.
    """
    roster = cut(roster.filter(F.col("cluster_name").isin(*NAMED)))  # some thirty fits and counts read these
    rows = cut(panel.join(roster.select("station_id", "cluster_name"), "station_id"))
    fits = stats.regress2(rows, "magnitude", "temp_mean_c", "precip_mm", "station_id")
    station = _weather(fits.join(roster.select("station_id", F.col("magnitude").alias("m")), "station_id"), "station_id", F.col("n"), F.col("m"))
    counts = rows.groupBy("station_id").agg(F.count("*").alias("n_obs"))
    station = roster.filter("magnitude <> 0").join(station, "station_id", "left").join(counts, "station_id", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    curves = {name: capacity_curve(roster.filter(F.col("cluster_name") == name)) for name in NAMED}

    def placed(capacity, magnitude):
        cells = [F.lit(None).cast("double")] * 3
        for name, curve in curves.items():
            if curve is not None:
                here = (F.col("cluster_name") == name) & (capacity > 0)
                cells = [F.when(here, new).otherwise(old) for new, old in zip(_at(curve, capacity, magnitude), cells)]
        return {f"capacity_{c}": v for c, v in zip(("elasticity", "low", "high"), cells)}

    station = cut(station.withColumns(placed(F.col("capacity").cast("double"), F.col("magnitude"))))
    known = (F.col("capacity") > 0) & F.col("throughput").isNotNull()
    group = roster.groupBy("cluster_name").agg(
        F.count("*").alias("n_stations"), F.count_if(known).alias("n_stations_with_capacity"), F.avg("magnitude").alias("m"), F.avg(F.when(known, F.col("capacity").cast("double"))).alias("c"),
        F.bround(F.corr(F.when(known, F.col("capacity").cast("double")), F.when(known, F.col("throughput").cast("double"))), 4).alias("capacity_throughput_correlation"))
    days = rows.groupBy("cluster_name").agg(F.countDistinct("date").alias("days"), F.count("*").alias("n_daily_observations"))
    fits = stats.regress2(rows, "magnitude", "temp_mean_c", "precip_mm", "cluster_name").join(days, "cluster_name").join(group.select("cluster_name", "m"), "cluster_name")
    types = group.join(days.drop("days"), "cluster_name", "left").join(_weather(fits, "cluster_name", F.col("days"), F.col("m")), "cluster_name", "left").withColumns(placed(F.col("c"), F.col("m")))
    rho = []
    for name in NAMED:
        r = stats.spearman(station.filter((F.col("cluster_name") == name) & F.col("capacity_elasticity").isNotNull()), "capacity", "capacity_elasticity").first()["rho"]
        rho.append((name, None if r is None or r != r else float(r)))
    ranks = roster.sparkSession.createDataFrame(rho, "cluster_name string, rho double")
    types = types.join(F.broadcast(ranks), "cluster_name", "left").withColumns({"rank_correlation": F.bround("rho", 4), "ceiling": F.coalesce(F.col("rho") <= C.CEILING_RHO, F.lit(False))})
    return types.drop("m", "c", "rho"), station.drop("throughput", "magnitude")
