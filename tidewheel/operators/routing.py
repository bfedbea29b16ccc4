"""Greedy truck tours over flagged stations, fleet sweeps, weather scenarios."""
from __future__ import annotations

from math import asin, cos, radians, sin, sqrt

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel import constants as C
from tidewheel.functions import scalars as S
from tidewheel.session import prepare_workers

STOPS = "truck int, capped boolean, stop int, station_id string, action string, amount int, running_load int"


def candidates(curves: DataFrame) -> DataFrame:
    """Stations out of balance in the AM hours (edges included); magnitude is the half-even rounded amount."""
    am = curves.withColumn("am_net", S.hour_sum("curve", C.AM_HOURS))
    kind = F.when(F.col("am_net") <= C.DEFICIT, "deficit").when(F.col("am_net") >= C.SURPLUS, "surplus")
    return am.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("magnitude", F.bround(F.abs("am_net"), 0).cast("int"))


def select_period(curves: DataFrame, period: str | None) -> DataFrame:
    """Curves of one period ('all' by default); an unknown period raises, a station without it is left out."""
    period = period or "all"
    out = curves.filter(F.col("period") == period)
    if not out.limit(1).count():
        raise ValueError(f"unknown period {period!r}")
    return out


def _metres(a, b):
    p, q, r, s = map(radians, (a["lat"], a["lng"], b["lat"], b["lng"]))
    return 2 * C.EARTH_M * asin(sqrt(sin((r - p) / 2) ** 2 + cos(p) * cos(r) * sin((s - q) / 2) ** 2))


def tour(stations: list[dict], left: dict, capacity: int, max_stops: int) -> tuple[list[tuple], bool]:
    """One truck: from the largest open surplus, always on to the nearest station its load allows.

    ``left`` is what each station still needs or offers; it is used up in place.  The second value
    is True whenever the tour ends on its number of stops.
    """
    surplus = [s for s in stations if s["kind"] == "surplus" and left[s["station_id"]] > 0]
    if not surplus or max_stops <= 0:
        return [], False
    here = max(surplus, key=lambda s: left[s["station_id"]])
    load, stops = 0, []
    while True:
        ident = here["station_id"]
        picks = here["kind"] == "surplus"
        amount = min(capacity - load if picks else load, left[ident])
        left[ident] -= amount
        load += amount if picks else -amount
        stops.append((ident, "pickup" if picks else "dropoff", amount, load))
        if len(stops) >= max_stops:
            return stops, True
        kinds = {"surplus"} if load <= 0 else {"deficit"} if load >= capacity else {"surplus", "deficit"}
        open_ = [s for s in stations if s["kind"] in kinds and left[s["station_id"]] > 0]
        if not open_:
            return stops, False
        here = min(open_, key=lambda s: _metres(here, s))


def plan(stations: list[dict], trucks: int, capacity: int = C.TRUCK_CAPACITY, max_stops: int = C.MAX_STOPS) -> tuple[list[tuple], dict]:
    """(stop rows, left over) of trucks that run one after another on shared state."""
    left, rows = {s["station_id"]: s["magnitude"] for s in stations}, []
    for t in range(1, trucks + 1):
        stops, capped = tour(stations, left, capacity, max_stops)
        if not stops:
            break
        rows += [(t, capped, i + 1, *s) for i, s in enumerate(stops)]
    return rows, left


def fleet_sweep(cands: DataFrame, sizes=C.FLEET_SIZES, capacity: int = C.TRUCK_CAPACITY, max_stops: int = C.MAX_STOPS) -> DataFrame:
    """One row per fleet size: trucks used, whether any is capped, flagged and fully serviced stations.

    Tours are sequential, so a scenario is one task over the flagged stations of one city
    (thousands); scenarios run in parallel.
    """
    spark = cands.sparkSession
    prepare_workers(spark)
    packed = cands.select(F.struct("station_id", "lat", "lng", "kind", "magnitude").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("stations"))
    jobs = packed.join(spark.createDataFrame([(n,) for n in sizes], "n_trucks int")).repartition(len(sizes), "n_trucks")

    def run(batches):
        for pdf in batches:
            rows = []
            for n, raw in zip(pdf["n_trucks"], pdf["stations"]):
                stations = [dict(s) if isinstance(s, dict) else s.asDict() for s in raw]
                stops, left = plan(stations, int(n), capacity, max_stops)
                done = {k: sum(s["kind"] == k and left[s["station_id"]] == 0 for s in stations) for k in ("deficit", "surplus")}
                flagged = {k: sum(s["kind"] == k for s in stations) for k in ("deficit", "surplus")}
                rows.append((int(n), len({s[0] for s in stops}), any(s[1] for s in stops), flagged["deficit"], flagged["surplus"], done["deficit"], done["surplus"]))
            yield type(pdf)(rows, columns=["n_trucks", "n_used", "any_capped", "n_deficit_flagged", "n_surplus_flagged", "n_deficit_serviced", "n_surplus_serviced"])

    return jobs.mapInPandas(run, "n_trucks int, n_used int, any_capped boolean, n_deficit_flagged int, n_surplus_flagged int, n_deficit_serviced int, n_surplus_serviced int")


def route(cands: DataFrame, trucks: int = C.TRUCKS, capacity: int = C.TRUCK_CAPACITY, max_stops: int = C.MAX_STOPS) -> DataFrame:
    """Stop rows of a plan; the flagged stations of one city are collected, their tours are sequential."""
    rows = [r.asDict() for r in cands.orderBy("station_id").select("station_id", "lat", "lng", "kind", "magnitude").collect()]
    return cands.sparkSession.createDataFrame(plan(rows, trucks, capacity, max_stops)[0], STOPS)


def marginal(sweep: DataFrame) -> DataFrame:
    before = F.lag("n_deficit_serviced", 1, 0).over(W.orderBy("n_trucks"))
    return sweep.withColumn("marginal_serviced", F.col("n_deficit_serviced") - before)


def presets(spark) -> DataFrame:
    return spark.createDataFrame([(n, t, p) for n, t, p in C.PRESETS], "id string, temp_c double, precip_mm double")


def project(stations: DataFrame, by_station: DataFrame, by_group: DataFrame, scenario: tuple[float, float], reference: tuple[float, float]) -> DataFrame:
    """flow * (1 + e_t dT + e_p dP) by the station's elasticity, else its group's, else unadjusted.

    The formula is this library's own; the dashboard that held the original is not available.
    """
    dt, dp = scenario[0] - reference[0], scenario[1] - reference[1]
    out = stations.join(by_station.select("station_id", F.col("e_t").alias("s_t"), F.col("e_p").alias("s_p")), "station_id", "left")
    out = out.join(by_group.select("group", F.col("e_t").alias("g_t"), F.col("e_p").alias("g_p")), "group", "left")
    e = lambda a, b: F.coalesce(a, b, F.lit(0.0))
    return out.withColumn("projected", F.col("flow") * (1 + e("s_t", "g_t") * dt + e("s_p", "g_p") * dp)).drop("s_t", "s_p", "g_t", "g_p")
