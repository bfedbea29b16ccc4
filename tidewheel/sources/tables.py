"""Domain inputs derived from the generated tables.

The view texts are plain SQL that Spark and DuckDB both read, so queries and oracle start from
the same rows; ``{events}`` and the like name the source tables, ``{k}`` the JSON number of ``props``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _station(k: str, kind: str, event: str, when: str, rest: int) -> tuple[str, str]:
    kk = f"lpad(CAST({k} AS VARCHAR(10)), 2, '0')"
    ident = f"""CASE WHEN {kind} = 'error' THEN NULL WHEN {k} = 95 THEN '4095.1'
        WHEN {k} % 10 = 0 AND {event} % 7 = {rest} THEN concat('40', {kk}, '.1')
        WHEN {k} % 10 = 0 THEN concat('40', {kk}, '.10') ELSE concat('40', {kk}, '.05') END"""
    name = f"""CASE WHEN {kind} = 'error' OR ({k} = 77 AND {event} % 5 = 0) THEN NULL
        WHEN {k} % 25 = 3 AND {when} >= TIMESTAMP '2024-01-16 00:00:00' THEN concat('Station ', CAST({k} AS VARCHAR(10)), ' North')
        ELSE concat('Station ', CAST({k} AS VARCHAR(10))) END"""
    return ident, name




def _lat(k: str) -> str:
    return f"(CAST(40.62 AS DOUBLE) + ({k} % 10) * CAST(0.028 AS DOUBLE))"


def _lng(k: str) -> str:
    return f"(CAST(-74.06 AS DOUBLE) + CAST(({k} - {k} % 10) / 10 AS INT) * CAST(0.022 AS DOUBLE))"


_S, _E = _station("k", "event_type", "event_id", "ts", 0), _station("k2", "type2", "event_id", "ts2", 1)
TRIPS = f"""
    SELECT event_id AS ride_id, CASE WHEN user_id % 2 = 0 THEN 'electric_bike' ELSE 'classic_bike' END AS rideable_type,
        ts AS started_at, ts2 AS ended_at, {_S[0]} AS start_station_id, {_E[0]} AS end_station_id, {_S[1]} AS start_station_name, {_E[1]} AS end_station_name,
        CASE WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE {_lat('k')} END AS start_lat,
        CASE WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE {_lng('k')} END AS start_lng,
        CASE WHEN event_id % 89 = 0 THEN NULL ELSE {_lat('k2')} END AS end_lat,
        CASE WHEN event_id % 89 = 0 THEN NULL ELSE {_lng('k2')} END AS end_lng,
        CASE WHEN user_id % 3 = 0 THEN 'casual' ELSE 'member' END AS member_casual
    FROM (SELECT *, lead(ts) OVER w AS ts2, lead(k) OVER w AS k2, lead(event_type) OVER w AS type2
          FROM (SELECT *, CAST({{k}} AS INT) AS k FROM {{events}}) e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x
    WHERE ts2 IS NOT NULL"""
DAILY = """
    SELECT station_id, station_name, d, h, lat, lng, CAST(sum(a) AS BIGINT) AS arrivals_count, CAST(sum(1 - a) AS BIGINT) AS departures_count, CAST(sum(2 * a - 1) AS BIGINT) AS net
    FROM (SELECT concat('N', lpad(CAST(n AS VARCHAR(10)), 2, '0')) AS station_id, concat('Nation ', CAST(n AS VARCHAR(10))) AS station_name, d, h, a,
              CAST(40.6 AS DOUBLE) + n * CAST(0.01 AS DOUBLE) AS lat, CAST(-74.0 AS DOUBLE) + n * CAST(0.005 AS DOUBLE) AS lng
          FROM (SELECT c_nationkey AS n, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 24 AS INT) AS h, 0 AS a
                FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
                UNION ALL
                SELECT s_nationkey, CAST(l_shipdate AS DATE), CAST(l_orderkey % 24 AS INT), 1 FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey) m) q
    GROUP BY station_id, station_name, d, h, lat, lng"""
SNAPSHOTS = """
    SELECT CAST(4000 + k AS BIGINT) AS station_id, date_trunc('hour', ts) AS observed_at, CAST(CAST(floor(value) AS BIGINT) % 6 AS BIGINT) AS bikes_available,
        CAST(event_id % 7 AS BIGINT) AS docks_available, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS is_renting,
        CASE WHEN user_id % 50 = 0 THEN 0 ELSE 1 END AS is_returning, event_id
    FROM (SELECT *, CAST({k} AS INT) AS k FROM {events}) e"""
STATIONS = f"""
    SELECT CAST(4000 + k AS BIGINT) AS station_id, concat('Station ', CAST(k AS VARCHAR(10))) AS name, {_lat('k')} AS lat, {_lng('k')} AS lng, CAST(10 + (k * 7) % 50 AS BIGINT) AS capacity
    FROM (SELECT DISTINCT CAST({{k}} AS INT) AS k FROM {{events}}) e"""
FACILITIES = """
    SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'housing' WHEN s_suppkey % 3 = 1 THEN 'school' ELSE 'subway' END AS layer, s_suppkey AS ordinal, s_name AS name,
        CAST(40.60 AS DOUBLE) + CAST((s_suppkey * 37) % 300 AS DOUBLE) / 1000 AS lat, CAST(-74.07 AS DOUBLE) + CAST((s_suppkey * 53) % 250 AS DOUBLE) / 1000 AS lng
    FROM {supplier}"""
WEATHER = """
    SELECT d, zone, CAST((dayofyear(d) * 7 + zone * 3) % 40 - 8 AS DOUBLE) AS temp_mean_c,
        CASE WHEN (dayofyear(d) * 11 + zone * 5) % 23 > 15 THEN ((dayofyear(d) * 11 + zone * 5) % 23 - 15) * CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS precip_mm
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, r_regionkey AS zone FROM {orders} CROSS JOIN {region}) x"""
STATION_ZONE = "SELECT concat('N', lpad(CAST(n_nationkey AS VARCHAR(10)), 2, '0')) AS station_id, n_regionkey AS zone FROM {nation}"
VIEWS = {"v_trips": TRIPS, "v_daily": DAILY, "v_snapshots": SNAPSHOTS, "v_stations": STATIONS, "v_facilities": FACILITIES, "v_weather": WEATHER, "v_zones": STATION_ZONE}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SPARK_K, DUCK_K = "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A generated table, only the given columns if any (the scan is pruned to them)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over the tables of ``sf_dir``."""
    text = VIEWS[name]
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{k}", SPARK_K), **used)


def duck(name: str) -> str:
    """The same view as DuckDB SQL over registered tables."""
    text = VIEWS[name].replace("{k}", DUCK_K)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def timestamped(df: DataFrame, *columns: str) -> DataFrame:
    """Zoneless times as timestamps (UTC sessions), which watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})
