"""Nearest facility, within-radius pairs, context flags and grid zones, by grid cells instead of all pairs."""
from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.functions import scalars as S
from tidewheel.session import cut

DEGREE_M = 111_194.0  # a little less than a degree of latitude, so cells are never too small


def _cells(lat: str, lng: str, metres: float, widest_lat: float) -> tuple[Column, Column]:
    step = metres / DEGREE_M * 1.001
    wide = step / max(0.01, cos(radians(min(89.0, abs(widest_lat)))))
    return F.floor(F.col(lat) / F.lit(step)).cast("long"), F.floor(F.col(lng) / F.lit(wide)).cast("long")


def _around(df: DataFrame, y: Column, x: Column) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumns({"_y": y, "_x": x}).withColumn("_n", F.explode(steps)).withColumns({"_y": F.col("_y") + F.col("_n.i"), "_x": F.col("_x") + F.col("_n.j")}).drop("_n")


def _widest(*frames: DataFrame) -> float:
    tops = [f.agg(F.max(F.abs("lat")).alias("m")).first()["m"] for f in frames]
    return max([t for t in tops if t is not None], default=0.0)


def within(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs of rows no farther apart than ``metres``, as ``a``'s columns, ``b``'s prefixed with ``other_``, and ``dist_m``."""
    top = _widest(a, b)
    near = _around(a.filter("lat IS NOT NULL AND lng IS NOT NULL"), *_cells("lat", "lng", metres, top))
    y, x = _cells("lat", "lng", metres, top)
    other = b.filter("lat IS NOT NULL AND lng IS NOT NULL").withColumns({"_y": y, "_x": x}).select("_y", "_x", *[F.col(c).alias(f"other_{c}") for c in b.columns])
    pairs = near.join(other, ["_y", "_x"]).drop("_y", "_x")
    return pairs.withColumn("dist_m", S.haversine("lat", "lng", "other_lat", "other_lng")).filter(F.col("dist_m") <= metres)


def nearest(points: DataFrame, facilities: DataFrame, key: str = "station_id", start_m: float = 2000.0, by: str | None = None) -> DataFrame:
    """Each point's nearest facility (first by ``ordinal`` on a tie): key, nearest, dist_m.

    With ``by``, a column of the facilities (their layer), the nearest of each of its values, in the same passes.
    A hit within the cell size is exact; points without one try four times the size, until the size
    covers the globe.  Only a count of open points reaches the driver; each round is checkpointed, a row per point.
    Cells do not wrap at 180 degrees, so rows of one city must not stand on both sides of that meridian.
    """
    group = [by] if by else []
    keys, places = [key, *group], facilities.select("name", "ordinal", "lat", "lng", *group)
    open_ = points.select(key, "lat", "lng")
    if by:
        open_ = open_.join(F.broadcast(facilities.select(by).distinct()))  # a few layers
    found, metres = None, start_m
    while True:
        pairs = within(open_, places, metres)
        if by:
            pairs = pairs.filter(F.col(by) == F.col(f"other_{by}"))
        best = pairs.groupBy(*keys).agg(F.min_by(F.struct("other_name", "dist_m"), F.struct("dist_m", "other_ordinal")).alias("b"))
        best = cut(best.select(*keys, F.col("b.other_name").alias("nearest"), F.col("b.dist_m").alias("dist_m")))
        found = best if found is None else found.unionByName(best)
        open_ = open_.join(best.select(*keys), keys, "left_anti")
        if metres > 4.2e7 or not open_.limit(1).count():
            return found
        metres *= 4


def context(stations: DataFrame, facilities: DataFrame) -> DataFrame:
    """Distances and flags per station; flags use unrounded distances.  A layer without facilities leaves its columns null."""
    n = nearest(stations, facilities, by="layer")
    of = lambda layer, c: F.max(F.when(F.col("layer") == layer, F.col(c)))  # noqa: E731  one row of each
    layers = ("housing", "school", "subway")
    out = n.groupBy("station_id").agg(*[of(v, "dist_m").alias(f"_{v}") for v in layers], *[of(v, "nearest").alias(f"{v}_nearest") for v in layers])
    flag = lambda c: c.cast("int")
    return out.select(
        "station_id", *[F.bround(f"_{v}", 0).cast("int").alias(f"{v}_dist_m") for v in layers],
        "housing_nearest", "school_nearest", "subway_nearest", flag(F.col("_housing") <= C.NEAR_HOUSING_M).alias("near_housing"),
        flag(F.col("_school") <= C.NEAR_SCHOOL_M).alias("near_school"), flag(F.col("_subway") >= C.TRANSIT_GAP_M).alias("transit_gap"))


def zones(stations: DataFrame, cell_km: float = C.ZONE_CELL_KM) -> DataFrame:
    """Grid cell of each station: nearest cell centre (first on a tie), occupied cells numbered in order.

    The nearest centre is among the nine around a station's own cell, so no station meets all centres.
    """
    box = stations.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("min", F.min), ("max", F.max))])
    km = lambda *a: S.haversine(*a, radius=C.EARTH_KM)
    box = box.withColumns({
        "rows": F.greatest(F.lit(1), F.ceil(km("min_lat", "min_lng", "max_lat", "min_lng") / cell_km)).cast("int"),
        "cols": F.greatest(F.lit(1), F.ceil(km("min_lat", "min_lng", "min_lat", "max_lng") / cell_km)).cast("int"),
    })
    s = stations.select("station_id", "lat", "lng").join(F.broadcast(box))  # one row
    place = lambda c, n: F.least(F.col(n) - 1, F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"min_{c}")) * F.col(n), F.col(f"max_{c}") - F.col(f"min_{c}")), F.lit(0.0)))).cast("int")
    around = lambda c, n: F.explode(F.sequence(F.greatest(place(c, n) - 1, F.lit(0)), F.least(place(c, n) + 1, F.col(n) - 1)))
    s = s.withColumn("r", around("lat", "rows")).withColumn("c", around("lng", "cols"))
    centre = lambda i, c, n: F.col(f"min_{c}") + (F.col(i) + 0.5) * (F.col(f"max_{c}") - F.col(f"min_{c}")) / F.col(n)
    s = s.withColumns({"zone_lat": centre("r", "lat", "rows"), "zone_lng": centre("c", "lng", "cols"), "cell": F.col("r") * F.col("cols") + F.col("c")})
    best = s.groupBy("station_id").agg(F.min_by(F.struct("cell", "zone_lat", "zone_lng"), F.struct(km("lat", "lng", "zone_lat", "zone_lng"), "cell")).alias("b"))
    best = best.select("station_id", "b.*")
    seen = best.groupBy("cell").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list("cell")).alias("cells"))  # cells of the box, not stations
    return best.join(F.broadcast(seen)).select("station_id", (F.array_position("cells", F.col("cell")) - 1).cast("int").alias("zone"), "zone_lat", "zone_lng")


def polygon_centroid(multi) -> Column:
    """(lat, lng) struct of a MultiPolygon's area centroid; rings after a polygon's first are holes; null stays null."""
    multi = S.col(multi)
    origin = multi[0][0][0]  # sums near the shape, not near the globe's origin, keep their digits

    def ring(points, sign):
        n = F.size(points)
        def step(acc, i):
            a, b = F.element_at(points, i), F.element_at(points, i + 1)
            ax, ay, bx, by = a[0] - origin[0], a[1] - origin[1], b[0] - origin[0], b[1] - origin[1]
            cross = ax * by - bx * ay
            return F.struct((acc["s"] + cross).alias("s"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        total = F.aggregate(F.sequence(F.lit(1), n - 1), zero, step)
        turn = F.when(total["s"] < 0, -1.0).otherwise(1.0) * sign
        return F.struct((total["s"] * turn).alias("s"), (total["x"] * turn).alias("x"), (total["y"] * turn).alias("y"))

    rings = F.flatten(F.transform(multi, lambda poly: F.transform(poly, lambda r, i: ring(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(rings, zero, lambda a, r: F.struct((a["s"] + r["s"]).alias("s"), (a["x"] + r["x"]).alias("x"), (a["y"] + r["y"]).alias("y")))
    return F.when(multi.isNotNull(), F.struct((origin[1] + F.try_divide(total["y"], 3 * total["s"])).alias("lat"), (origin[0] + F.try_divide(total["x"], 3 * total["s"])).alias("lng")))


def double_outage(status: DataFrame, metres: float = C.ADJACENT_M) -> DataFrame:
    """Unusable stations with another unusable one within ``metres``: one row, n_stations, n_breach, availability_pct."""
    bad = status.filter("unusable").select("station_id", "lat", "lng")
    hit = within(bad, bad, metres).filter("station_id <> other_station_id").select("station_id").distinct()
    total = status.agg(F.count("*").alias("n_stations"))
    return total.join(hit.agg(F.count("*").alias("n_breach"))).withColumn("availability_pct", F.bround(100 * (1 - F.col("n_breach") / F.col("n_stations")), 3))  # two one-row frames
