"""Facility frames from raw records: open schools, subway entrances, housing polygons."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewheel.operators.geo import polygon_centroid


def open_schools(raw: DataFrame) -> DataFrame:
    """name, lat, lng of open schools with usable coordinates (text columns, "" and "NULL" possible)."""
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return raw.filter((F.col("status_descriptions") == "Open") & lat.isNotNull() & lng.isNotNull()).select(F.col("location_name").alias("name"), lat.alias("lat"), lng.alias("lng"))


def subway_entrances(raw: DataFrame) -> DataFrame:
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return raw.filter(lat.isNotNull() & lng.isNotNull()).select(F.coalesce("stop_name", F.lit("")).alias("name"), lat.alias("lat"), lng.alias("lng"))


def housing(raw: DataFrame) -> DataFrame:
    """name, lat, lng of each development's area centroid; ``geometry`` is a MultiPolygon's coordinates, null ones are left out."""
    c = polygon_centroid("geometry")
    return raw.filter("geometry IS NOT NULL").select("name", c["lat"].alias("lat"), c["lng"].alias("lng"))
