"""Dashboard slices: totals, buckets and live distributions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewheel.operators.ordered import quantile


def totals(points: DataFrame) -> DataFrame:
    """Per (period, day type, hour): bikes out of place, bikes to move, stations covered; summed in whole thousandths."""
    k = F.bround(F.col("value") * 1000, 0).cast("long")
    whole = lambda c: F.bround(F.sum(c) / 1000, 0)
    return points.groupBy("period", "day_type", "hour").agg(
        whole(F.abs(k)).alias("out_of_place"), whole(F.when(k < 0, -k).otherwise(0)).alias("to_move"), F.countDistinct("station_id").alias("n_stations"))


def buckets(points: DataFrame, inner: float = 1.0) -> DataFrame:
    """Five net-flow buckets per slice; the scale ends at the 95th percentile of absolute values.

    The inner cut is this library's choice; the original cut points are not available.
    """
    end = quantile(points, F.abs(F.col("value")), 0.95, ["period", "day_type", "hour"], "scale_end")
    v, half = F.col("value"), F.col("scale_end") / 2
    name = (F.when(v.between(-inner, inner), "near_balanced").when(v <= -F.greatest(half, F.lit(inner)), "big_deficit").when(v < 0, "deficit")
            .when(v >= F.greatest(half, F.lit(inner)), "big_surplus").otherwise("surplus"))
    return points.join(end, ["period", "day_type", "hour"]).groupBy("period", "day_type", "hour", name.alias("bucket")).agg(F.count("*").alias("n"), F.max("scale_end").alias("scale_end"))


def live(status: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations with a live reading: known, with a capacity, renting and returning; fill_pct is bikes over capacity."""
    rows = status.join(stations.select("station_id", "capacity"), "station_id").filter((F.col("capacity") > 0) & (F.col("is_renting") == 1) & (F.col("is_returning") == 1))
    return rows.withColumn("fill_pct", F.col("bikes_available") / F.col("capacity"))


def fill_distribution(rows: DataFrame) -> DataFrame:
    """Stations by fill bucket: 0 empty, 4 full, 1 to 3 by thirds; empty and full at once counts as empty, n_both tells how many."""
    pct = F.col("fill_pct")
    empty, full = F.col("bikes_available") == 0, F.col("docks_available") == 0
    b = F.when(empty, 0).when(full, 4).when(pct < 1 / 3, 1).when(pct < 2 / 3, 2).otherwise(3)
    return rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(empty & full).alias("n_both"))
