"""Named queries over the domain views, each with the DuckDB SQL that gives the same rows.

A query takes a :class:`Frames`, which builds the shared inputs of one data folder lazily.  SQL texts
may use the views and the common tables of :data:`COMMON`; :func:`sql` puts the needed ones in front.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewheel.operators import flows, quality
from tidewheel.session import cut
from tidewheel.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Frames:
    """The domain views of one folder, and the frames most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return tables.view(self.spark, self.sf_dir, f"v_{name}")

    def table(self, name: str, *columns: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name, *columns)

    @cached_property
    def raw_trips(self) -> DataFrame:
        """Trips as a stored table: the view over events is a sort of all of them, and most queries read trips twice or more."""
        return cut(self.view("trips"))

    @cached_property
    def trips(self) -> DataFrame:
        return quality.canonicalize(self.raw_trips, "start_station_id", "end_station_id")

    @cached_property
    def clean(self) -> DataFrame:
        return quality.clean(self.trips)

    @cached_property
    def daily(self) -> DataFrame:
        return self.view("daily").withColumnsRenamed({"d": "date", "h": "hour"})

    @cached_property
    def monthly(self) -> DataFrame:
        return flows.monthly_from_daily(cut(self.daily))  # read twice, for sums and for days

    @cached_property
    def points(self) -> DataFrame:
        return flows.curve_points(self.monthly)

    @cached_property
    def weekday(self) -> DataFrame:
        """All-period weekday curves: station_id, curve."""
        return self.curve("weekday")

    def curve(self, day_type: str) -> DataFrame:
        return flows.curves(self.points.filter((F.col("grain") == "all") & (F.col("day_type") == day_type)), "station_id")

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.view("snapshots")

    @cached_property
    def stations(self) -> DataFrame:
        return self.view("stations")

    @cached_property
    def facilities(self) -> DataFrame:
        return self.view("facilities")

    @cached_property
    def weather(self) -> DataFrame:
        return self.view("weather").withColumnRenamed("d", "date")

    @cached_property
    def zones(self) -> DataFrame:
        return self.view("zones")

    @cached_property
    def panel(self) -> DataFrame:
        """Mean absolute flow per station and date with the zone's weather."""
        rows = self.daily.groupBy("station_id", "date").agg(F.avg(F.abs("net")).alias("magnitude"))
        return rows.join(self.zones, "station_id").join(self.weather, ["zone", "date"])


def query(name: str, text: str | None = None, days: tuple[str, ...] = ()):
    """Register a query of a :class:`Frames` under ``name``; ``days`` names dates and times that both sides return as text."""

    def register(f):
        as_text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in days}) if days else df
        QUERIES[name] = lambda spark, sf_dir: as_text(f(Frames(spark, sf_dir)))
        if text is not None:
            body = sql(text)
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in days)
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({body})" if days else body
        return f

    return register


def _dist(a: str, b: str, c: str, d: str, r: str = "6371000.0") -> str:
    return (f"(CAST(2 * {r} AS DOUBLE) * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))")


def _curve(day_type: str) -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN hour = {h} THEN value END), 0.0)" for h in range(24))
    return f"SELECT station_id, [{cells}] AS curve FROM points WHERE grain = 'all' AND day_type = '{day_type}' GROUP BY station_id"


_DAY = "CASE WHEN isodow({0}) >= 6 THEN 'weekend' ELSE 'weekday' END"
_SEASON = "CASE WHEN CAST(substr({0}, 6, 2) AS INT) IN (12, 1, 2) THEN 'winter' WHEN CAST(substr({0}, 6, 2) AS INT) <= 5 THEN 'spring' WHEN CAST(substr({0}, 6, 2) AS INT) <= 8 THEN 'summer' ELSE 'fall' END"
_SIDE_KEYS = "sign, station_id, station_name"
_MED = "median(lat) AS lat, median(lng) AS lng"
COMMON = {name: tables.duck(name) for name in tables.VIEWS} | {
    "ids": "SELECT start_station_id AS id FROM v_trips WHERE start_station_id IS NOT NULL UNION SELECT end_station_id FROM v_trips WHERE end_station_id IS NOT NULL",
    "cmap": r"SELECT a.id, b.id AS canonical FROM ids a JOIN ids b ON b.id = a.id || '0' WHERE regexp_full_match(a.id, '\d+\.\d')",
    "trips": "SELECT v_trips.* REPLACE (coalesce(m.canonical, start_station_id) AS start_station_id, coalesce(n.canonical, end_station_id) AS end_station_id) FROM v_trips LEFT JOIN cmap m ON start_station_id = m.id LEFT JOIN cmap n ON end_station_id = n.id",
    "tagged": """SELECT *, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS duration_s, coalesce((epoch_us(ended_at) - epoch_us(started_at)) / 1e6 < 60, false) AS is_short,
        coalesce((epoch_us(ended_at) - epoch_us(started_at)) / 1e6 > 14400, false) AS is_long,
        coalesce(start_lat BETWEEN 39.5 AND 41.5, true) AND coalesce(start_lng BETWEEN -75 AND -73, true) AND coalesce(end_lat BETWEEN 39.5 AND 41.5, true) AND coalesce(end_lng BETWEEN -75 AND -73, true) AS is_inside,
        end_station_id IS NOT NULL AS has_valid_arrival_station, start_station_id IS NOT NULL AS has_valid_departure_station FROM trips""",
    "clean": "SELECT * FROM tagged WHERE NOT is_short AND NOT is_long AND is_inside",
    "sides": f"""SELECT *, strftime(moment, '%Y-%m') AS month, {_DAY.format('moment')} AS day_type, CAST(moment AS DATE) AS date, CAST(hour(moment) AS INT) AS hour FROM (
        SELECT end_station_id AS station_id, end_station_name AS station_name, ended_at AS moment, end_lat AS lat, end_lng AS lng, CAST(1 AS BIGINT) AS sign FROM clean WHERE end_station_id IS NOT NULL
        UNION ALL SELECT start_station_id, start_station_name, started_at, start_lat, start_lng, -1 FROM clean WHERE start_station_id IS NOT NULL)""",
    "ndays": f"SELECT strftime(d, '%Y-%m') AS month, {_DAY.format('d')} AS day_type, count(*) AS n_days FROM (SELECT CAST(started_at AS DATE) AS d FROM clean UNION SELECT CAST(ended_at AS DATE) FROM clean) WHERE d IS NOT NULL GROUP BY ALL",
    "side_m": f"SELECT {_SIDE_KEYS}, month, day_type, hour, CAST(sum(sign) AS BIGINT) AS net, {_MED} FROM sides WHERE station_name IS NOT NULL GROUP BY ALL",
    "side_d": f"SELECT {_SIDE_KEYS}, date, hour, CAST(sum(sign) AS BIGINT) AS net, {_MED} FROM sides WHERE station_name IS NOT NULL GROUP BY ALL",
    "net_m": f"SELECT station_id, station_name, month, day_type, hour, CAST(sum(net) AS BIGINT) AS net, {_MED} FROM side_m GROUP BY ALL",
    "daily": "SELECT * RENAME (d AS date, h AS hour) FROM v_daily",
    "dkeys": f"SELECT *, strftime(date, '%Y-%m') AS month, {_DAY.format('date')} AS day_type FROM daily",
    "ddays": "SELECT month, day_type, count(DISTINCT date) AS n_days FROM dkeys GROUP BY ALL",
    "monthly": f"SELECT *, round_even(net / greatest(n_days, 1), 3) + 0.0 AS net_per_day FROM (SELECT station_id, station_name, month, day_type, hour, CAST(sum(net) AS BIGINT) AS net, {_MED} FROM dkeys GROUP BY ALL) JOIN ddays USING (month, day_type)",
    "points": f"""SELECT station_id, CASE WHEN month IS NOT NULL THEN 'month' WHEN season IS NOT NULL THEN 'season' ELSE 'all' END AS grain, coalesce(month, season, 'all') AS period, day_type, hour, round_even(CAST(sum(w) AS BIGINT) / CAST(sum(n_days) AS BIGINT), 0) / 1000 + 0.0 AS value
        FROM (SELECT *, {_SEASON.format('month')} AS season, CAST(round_even(net_per_day * 1000, 0) AS BIGINT) * n_days AS w FROM monthly)
        GROUP BY GROUPING SETS ((station_id, day_type, hour), (station_id, day_type, hour, season), (station_id, day_type, hour, month))""",
    "wkday": _curve("weekday"), "wkend": _curve("weekend"),
    "zones": "SELECT * FROM v_zones", "weather": "SELECT * RENAME (d AS date) FROM v_weather", "stations": "SELECT * FROM v_stations",
    "snaps": "SELECT *, is_renting = 1 AND is_returning = 1 AS is_online, bikes_available = 0 AS is_empty, docks_available = 0 AS is_full, bikes_available = 0 OR docks_available = 0 AS unusable FROM v_snapshots",
    "rel": "SELECT station_id, count(*) AS n_observations, count(*) FILTER (unusable) AS n_unusable, count(*) FILTER (unusable) / count(*) AS unusable_rate FROM snaps WHERE is_online GROUP BY station_id",
    "latest": "SELECT station_id, observed_at, bikes_available, docks_available, is_renting, is_returning FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM v_snapshots) WHERE rn = 1",
    "panel": "SELECT m.station_id, m.date, magnitude, zone, temp_mean_c, precip_mm FROM (SELECT station_id, date, avg(abs(net)) AS magnitude FROM daily GROUP BY ALL) m JOIN zones USING (station_id) JOIN weather USING (zone, date)",
    "near": f"""SELECT station_id, layer, arg_min(f.name, {{'d': {_dist('s.lat', 's.lng', 'f.lat', 'f.lng')}, 'o': ordinal}}) AS nearest, min({_dist('s.lat', 's.lng', 'f.lat', 'f.lng')}) AS dist_m
        FROM stations s, v_facilities f GROUP BY ALL""",
    "cands": "SELECT station_id, am_net, CASE WHEN am_net <= -1.0 THEN 'deficit' ELSE 'surplus' END AS kind, CAST(round_even(abs(am_net), 0) AS INT) AS magnitude FROM (SELECT station_id, curve[7] + curve[8] + curve[9] + curve[10] AS am_net FROM wkday) WHERE am_net <= -1.0 OR am_net >= 1.0",
    "demand": "SELECT k AS station_id, avg(n) AS demand FROM (SELECT CAST(4000 + CAST(json_extract_string(props, '$.k') AS INT) AS BIGINT) AS k, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY k",
    "joined": "SELECT r.station_id, unusable_rate, capacity, demand FROM rel r JOIN stations USING (station_id) JOIN demand USING (station_id) WHERE n_observations >= 20 AND capacity > 0",
}
_ORDER = list(COMMON)


def sql(text: str) -> str:
    """``text`` with the common tables it uses, and theirs, in front."""
    need, todo = set(), [text]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for name in words & COMMON.keys() - need:
            need.add(name)
            todo.append(COMMON[name])
    parts = [f"{n} AS MATERIALIZED ({COMMON[n]})" for n in _ORDER if n in need]
    body = text.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:].split("\nSELECT", 1)[0])
        body = "SELECT" + body[5:].split("\nSELECT", 1)[1]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


dist = _dist
