"""Trip quality control and station-id canonicalization."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.functions import scalars as S


def _inside(lat: str, lng: str):
    """A missing coordinate passes."""
    ok = F.col(lat).between(*C.LAT_BOX) & F.col(lng).between(*C.LNG_BOX)
    return F.coalesce(F.col(lat).between(*C.LAT_BOX), F.lit(True)) & F.coalesce(F.col(lng).between(*C.LNG_BOX), F.lit(True)) & F.coalesce(ok, F.lit(True))


def tag(trips: DataFrame) -> DataFrame:
    """Trips with duration, quality verdicts and station flags; no row is dropped.

    A trip without a duration is neither short nor long; a missing coordinate is inside.
    """
    t = trips.withColumn("duration_s", S.duration_s("started_at", "ended_at"))
    return t.withColumns({
        "is_short": F.coalesce(F.col("duration_s") < C.MIN_TRIP_S, F.lit(False)),
        "is_long": F.coalesce(F.col("duration_s") > C.MAX_TRIP_S, F.lit(False)),
        "is_inside": _inside("start_lat", "start_lng") & _inside("end_lat", "end_lng"),
        "has_valid_arrival_station": F.col("end_station_id").isNotNull(),
        "has_valid_departure_station": F.col("start_station_id").isNotNull(),
    })


def clean(trips: DataFrame) -> DataFrame:
    return tag(trips).filter(~F.col("is_short") & ~F.col("is_long") & F.col("is_inside")).drop("is_short", "is_long", "is_inside")


def report(trips: DataFrame) -> DataFrame:
    """The seven audit counts in one pass; locations are judged on trips of a valid duration."""
    lasts = ~F.col("is_short") & ~F.col("is_long")
    kept = lasts & F.col("is_inside")
    n = F.count_if
    return tag(trips).agg(
        F.count("*").alias("rows_in"), n(F.col("is_short")).alias("dropped_short"), n(F.col("is_long")).alias("dropped_long"),
        n(lasts & ~F.col("is_inside")).alias("dropped_bad_location"), n(kept).alias("rows_out"),
        n(kept & ~F.col("has_valid_departure_station")).alias("missing_start_station"), n(kept & ~F.col("has_valid_arrival_station")).alias("missing_end_station"),
    )


def canonical_map(frame: DataFrame, *columns: str) -> DataFrame:
    """(id, canonical): ``X.1`` to ``X.10`` where that id occurs in any column; listed suffix ids where their base does.

    Stations, not trips, bound its size.
    """
    ids = frame.select(F.explode(F.array(*columns)).alias("id")).filter("id IS NOT NULL").distinct()
    suffix = F.create_map(*[F.lit(x) for pair in C.SUFFIX_IDS.items() for x in pair])
    base = F.when(F.col("id").rlike(r"^\d+\.\d$"), F.concat("id", F.lit("0"))).otherwise(F.element_at(suffix, F.col("id")))
    wanted = ids.withColumn("canonical", base).filter("canonical IS NOT NULL")
    return wanted.join(ids.select(F.col("id").alias("canonical")), "canonical", "left_semi").select("id", "canonical")


def canonicalize(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame`` with every column's ids in canonical form; Spark picks the join by the map's size."""
    names = canonical_map(frame, *columns)
    out = frame
    for c in columns:
        out = out.join(names.select(F.col("id").alias("_id"), F.col("canonical").alias("_to")), F.col(c) == F.col("_id"), "left")
        out = out.withColumn(c, F.coalesce("_to", c)).drop("_id", "_to")
    return out


def drifted(frames: dict[str, list[str]]) -> list[str]:
    """Months whose columns differ from the first month's."""
    first = sorted(next(iter(frames.values()))) if frames else []
    return [m for m, cols in frames.items() if sorted(cols) != first]
