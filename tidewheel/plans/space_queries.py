"""Queries of availability, space, statistics, facts, forecasts and slices."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.functions import scalars as S
from tidewheel.operators import availability as A, facts, flows, forecast, geo, routing, slices, stats, typology
from tidewheel.operators.ordered import ordered
from tidewheel.plans.registry import dist, query


@query("p12_flt_online", "SELECT event_id FROM snaps WHERE is_online")
def _(x):
    return A.tag(x.snapshots).filter("is_online").select("event_id")


@query("p13_prj_unusable", "SELECT event_id, unusable FROM snaps")
def _(x):
    return A.tag(x.snapshots).select("event_id", "unusable")


@query("j8_jn_crosswalk_drop", "SELECT station_id, capacity, bikes_available, docks_available, is_renting = 1 AS is_renting, is_returning = 1 AS is_returning FROM latest JOIN stations USING (station_id) WHERE station_id % 10 <> 7")
def _(x):
    info = x.stations.filter("station_id % 10 <> 7").select(F.col("station_id").alias("feed_id"), "station_id", "capacity")
    status = A.latest(x.snapshots).withColumnRenamed("station_id", "feed_id")
    return A.live_status(status, info)[0]


@query("j8_crosswalk_dropped", "SELECT count(*) AS n_dropped FROM latest WHERE station_id % 10 = 7")
def _(x):
    info = x.stations.filter("station_id % 10 <> 7").select(F.col("station_id").alias("feed_id"), "station_id", "capacity")
    return A.live_status(A.latest(x.snapshots).withColumnRenamed("station_id", "feed_id"), info)[1]


@query("j11_jn_next_within", """SELECT count(*) AS n_with_next, count(*) FILTER (nu) AS n_still, count(*) FILTER (nu) / count(*) AS share FROM (
    SELECT unusable, observed_at, lead(observed_at) OVER w AS na, lead(unusable) OVER w AS nu FROM snaps WHERE is_online WINDOW w AS (PARTITION BY station_id ORDER BY observed_at, event_id))
    WHERE unusable AND epoch_us(na) - epoch_us(observed_at) <= 4200000000""")
def _(x):
    return A.persistence(x.snapshots)


@query("a13_agg_reliability_system", """SELECT count(*) FILTER (is_online) AS n_online, count(*) FILTER (is_online AND unusable) AS n_unusable, count(*) FILTER (is_online AND is_empty) AS n_empty,
    count(*) FILTER (is_online AND is_full) AS n_full, count(*) FILTER (NOT is_online) AS n_offline, count(*) FILTER (is_online AND unusable) / count(*) FILTER (is_online) AS unusable_rate FROM snaps""")
def _(x):
    return A.system(x.snapshots)


@query("a14_agg_reliability_station", "SELECT * FROM rel")
def _(x):
    return A.by_station(x.snapshots)


@query("a15_agg_reliability_summary", "SELECT count(*) AS n_stations, count(*) FILTER (n_observations >= 20) AS n_rankable, median(unusable_rate) FILTER (n_observations >= 20) AS median_rate, max(unusable_rate) FILTER (n_observations >= 20) AS max_rate FROM rel")
def _(x):
    return A.summary(x.snapshots)


_GAPS = "SELECT s AS start, e, (epoch_us(e) - epoch_us(s)) / 60e6 AS minutes FROM (SELECT s, lead(s) OVER (ORDER BY s) AS e FROM (SELECT DISTINCT observed_at AS s FROM v_snapshots)) WHERE e IS NOT NULL"


@query("a16_agg_window_gaps", f"""SELECT min(observed_at) AS first_at, max(observed_at) AS last_at, count(DISTINCT observed_at) AS n_snapshots, count(DISTINCT CAST(observed_at AS DATE)) AS n_days_with_data,
    CAST(date_diff('day', CAST(min(observed_at) AS DATE), CAST(max(observed_at) AS DATE)) + 1 AS INT) AS span_days, (SELECT median(minutes) FROM ({_GAPS})) AS median_gap_min, (SELECT max(minutes) FROM ({_GAPS})) AS max_gap_min,
    (SELECT start FROM ({_GAPS}) ORDER BY minutes DESC, start LIMIT 1) AS longest_gap_start FROM v_snapshots""", days=("first_at", "last_at", "longest_gap_start"))
def _(x):
    return A.window(x.snapshots)


@query("w3_win_gap", f"SELECT start, e AS \"end\", minutes FROM ({_GAPS})", days=("start",))
def _(x):
    return A.gaps(x.snapshots).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("w6_top_longest_gap", f"SELECT start, minutes FROM ({_GAPS}) ORDER BY minutes DESC, start LIMIT 1", days=("start",))
def _(x):
    return A.gaps(x.snapshots).orderBy(F.desc("minutes"), "start").limit(1).select("start", "minutes")


@query("f25_fn_epoch_ts", "SELECT event_id, CAST(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC' AS VARCHAR) AS t FROM events")
def _(x):
    return x.table("events", "event_id").select("event_id", F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("event_id")), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("j7_jn_nearest", "SELECT station_id, nearest, round_even(dist_m, 3) AS dist_m FROM near WHERE layer = 'subway'")
def _(x):
    n = geo.nearest(x.stations, x.facilities.filter("layer = 'subway'"))
    return n.select("station_id", "nearest", F.bround("dist_m", 3).alias("dist_m"))


# the city a tenth as wide, so that some stations stand within the operator's 500 m
_DENSE = "(SELECT station_id, CAST(40.7 AS DOUBLE) + (lat - CAST(40.7 AS DOUBLE)) / 10 AS lat, CAST(-73.96 AS DOUBLE) + (lng + CAST(73.96 AS DOUBLE)) / 10 AS lng, bikes_available = 0 OR docks_available = 0 AS bad FROM latest JOIN stations USING (station_id))"


@query("j10_jn_adjacency_self", f"SELECT DISTINCT a.station_id FROM {_DENSE} a, {_DENSE} b WHERE a.station_id <> b.station_id AND a.bad AND b.bad AND {dist('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 500")
def _(x):
    near = x.stations.select("station_id", (F.lit(40.7) + (F.col("lat") - F.lit(40.7)) / 10).alias("lat"), (F.lit(-73.96) + (F.col("lng") + F.lit(73.96)) / 10).alias("lng"))
    bad = A.tag(A.latest(x.snapshots)).filter("unusable").join(near, "station_id").select("station_id", "lat", "lng")
    return geo.within(bad, bad, C.ADJACENT_M).filter("station_id <> other_station_id").select("station_id").distinct()


@query("g1_geo_equity_context", """SELECT h.station_id, CAST(round_even(h.dist_m, 0) AS INT) AS housing_dist_m, CAST(round_even(c.dist_m, 0) AS INT) AS school_dist_m, CAST(round_even(s.dist_m, 0) AS INT) AS subway_dist_m,
    h.nearest AS housing_nearest, c.nearest AS school_nearest, s.nearest AS subway_nearest, CAST(h.dist_m <= 300 AS INT) AS near_housing, CAST(c.dist_m <= 300 AS INT) AS near_school, CAST(s.dist_m >= 800 AS INT) AS transit_gap
    FROM (SELECT * FROM near WHERE layer = 'housing') h JOIN (SELECT * FROM near WHERE layer = 'school') c USING (station_id) JOIN (SELECT * FROM near WHERE layer = 'subway') s USING (station_id)""")
def _(x):
    return geo.context(x.stations, x.facilities)


@query("a24_agg_equity_counts", """SELECT count(*) FILTER (h.dist_m <= 300) AS n_housing, count(*) FILTER (c.dist_m <= 300) AS n_school, count(*) FILTER (h.dist_m <= 300 OR c.dist_m <= 300) AS n_either, count(*) FILTER (h.dist_m <= 300 AND c.dist_m <= 300) AS n_both
    FROM (SELECT * FROM near WHERE layer = 'housing') h JOIN (SELECT * FROM near WHERE layer = 'school') c USING (station_id)""")
def _(x):
    c = geo.context(x.stations, x.facilities)
    h, s = F.col("near_housing") == 1, F.col("near_school") == 1
    return c.agg(F.count_if(h).alias("n_housing"), F.count_if(s).alias("n_school"), F.count_if(h | s).alias("n_either"), F.count_if(h & s).alias("n_both"))


@query("g2_geo_layer_metadata", "SELECT layer, count(*) AS n, CASE layer WHEN 'subway' THEN 800 ELSE 300 END AS threshold_m FROM v_facilities GROUP BY layer")
def _(x):
    return x.facilities.groupBy("layer").agg(F.count("*").alias("n")).withColumn("threshold_m", F.when(F.col("layer") == "subway", C.TRANSIT_GAP_M).otherwise(C.NEAR_SCHOOL_M))


_BOX = "SELECT min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM stations"
_GRID = f"""SELECT r * cols + c2 AS cell, a + (r + 0.5) * (b - a) / rows AS zlat, c + (c2 + 0.5) * (d - c) / cols AS zlng FROM (SELECT *, unnest(range(rows)) AS r FROM (SELECT *, unnest(range(cols)) AS c2 FROM (
    SELECT *, CAST(greatest(1, ceil({dist('a', 'c', 'b', 'c', '6371.0')} / 6.0)) AS INT) AS rows, CAST(greatest(1, ceil({dist('a', 'c', 'a', 'd', '6371.0')} / 6.0)) AS INT) AS cols FROM ({_BOX}))))"""


@query("g3_geo_grid_zones", f"""SELECT station_id, CAST(dense_rank() OVER (ORDER BY cell) - 1 AS INT) AS zone, round_even(zlat, 6) AS zone_lat, round_even(zlng, 6) AS zone_lng FROM (
    SELECT station_id, cell, zlat, zlng, row_number() OVER (PARTITION BY station_id ORDER BY {dist('lat', 'lng', 'zlat', 'zlng', '6371.0')}, cell) AS rn FROM stations, ({_GRID})) WHERE rn = 1""")
def _(x):
    return geo.zones(x.stations).select("station_id", "zone", F.bround("zone_lat", 6).alias("zone_lat"), F.bround("zone_lng", 6).alias("zone_lng"))


@query("g4_geo_double_outage", f"""SELECT count(*) AS n_stations, count(*) FILTER (hit) AS n_breach, round_even(100 * (1 - count(*) FILTER (hit) / count(*)), 3) AS availability_pct FROM (
    SELECT a.station_id, a.unusable AND coalesce(bool_or(b.unusable AND b.station_id <> a.station_id AND {dist('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 3500), false) AS hit
    FROM (SELECT station_id, lat, lng, bikes_available = 0 OR docks_available = 0 AS unusable FROM latest JOIN stations USING (station_id)) a, (SELECT station_id, lat, lng, bikes_available = 0 OR docks_available = 0 AS unusable FROM latest JOIN stations USING (station_id)) b
    GROUP BY a.station_id, a.unusable)""")
def _(x):
    s = A.tag(A.latest(x.snapshots)).join(x.stations.select("station_id", "lat", "lng"), "station_id")
    return geo.double_outage(s, 3500.0)


@query("f1_fn_haversine_m", f"SELECT ordinal, round_even({dist('lat', 'lng', 'CAST(40.7 AS DOUBLE)', 'CAST(-74.0 AS DOUBLE)')}, 3) AS m FROM v_facilities")
def _(x):
    return x.facilities.select("ordinal", F.bround(S.haversine("lat", "lng", F.lit(40.7), F.lit(-74.0)), 3).alias("m"))


@query("f2_fn_haversine_km", f"SELECT ordinal, round_even({dist('lat', 'lng', 'CAST(40.7 AS DOUBLE)', 'CAST(-74.0 AS DOUBLE)', '6371.0')}, 6) AS km FROM v_facilities")
def _(x):
    return x.facilities.select("ordinal", F.bround(S.haversine("lat", "lng", F.lit(40.7), F.lit(-74.0), radius=C.EARTH_KM), 6).alias("km"))


_NORM = "sqrt(list_sum([v * v for v in curve]))"


@query("f3_fn_l2_norm", f"SELECT station_id, round_even({_NORM}, 6) AS strength FROM wkday")
def _(x):
    return x.weekday.select("station_id", F.bround(S.l2_norm("curve"), 6).alias("strength"))


@query("f4_fn_l2_normalize", f"SELECT station_id, CAST(i - 1 AS INT) AS hour, round_even(v / norm, 6) + 0.0 AS value FROM (SELECT station_id, {_NORM} AS norm, unnest(curve) AS v, unnest(range(1, 25)) AS i FROM wkday)")
def _(x):
    return x.weekday.select("station_id", F.posexplode(S.l2_normalize("curve")).alias("hour", "value")).withColumn("value", F.bround("value", 6))


@query("f5_fn_mean_abs", "SELECT station_id, round_even(list_sum([abs(v) for v in curve]) / 24, 6) AS magnitude FROM wkday")
def _(x):
    return x.weekday.select("station_id", F.bround(S.mean_abs("curve"), 6).alias("magnitude"))


@query("f6_fn_am_pm_sum", "SELECT station_id, round_even(curve[8] + curve[9] + curve[10], 6) + 0.0 AS am, round_even(curve[18] + curve[19] + curve[20], 6) + 0.0 AS pm FROM wkday")
def _(x):
    return x.weekday.select("station_id", F.bround(S.hour_sum("curve", C.CHECK_AM_HOURS), 6).alias("am"), F.bround(S.hour_sum("curve", C.CHECK_PM_HOURS), 6).alias("pm"))


_LABEL = "CAST(CASE WHEN {0} % 12 = 0 THEN 12 ELSE {0} % 12 END AS VARCHAR) || CASE WHEN {0} < 12 THEN ' AM' ELSE ' PM' END"


@query("f7_fn_hour_label", f"SELECT DISTINCT hour, {_LABEL.format('hour')} AS label FROM daily")
def _(x):
    return x.daily.select("hour", S.hour_label("hour").alias("label")).distinct()


@query("f8_fn_hour_gap", "SELECT DISTINCT hour, CAST(least(abs(hour - 22) % 24, 24 - abs(hour - 22) % 24) AS INT) AS gap FROM daily")
def _(x):
    return x.daily.select("hour", S.hour_gap("hour", F.lit(22)).alias("gap")).distinct()


_FILL = "CASE WHEN round_even(list_max({0}), 1) > 0 THEN list_position({0}, list_max({0})) - 1 END"
_DRAIN = "CASE WHEN round_even(-list_min({0}), 1) > 0 THEN list_position({0}, list_min({0})) - 1 END"


@query("w4_win_argmax_first", f"SELECT station_id, CAST(list_position(curve, list_max(curve)) - 1 AS INT) AS fill, CAST(list_position(curve, list_min(curve)) - 1 AS INT) AS drain FROM wkday")
def _(x):
    return x.weekday.select("station_id", S.first_max_hour("curve").alias("fill"), S.first_min_hour("curve").alias("drain"))


@query("f9_fn_flow_peaks", f"""SELECT station_id, {_LABEL.format('f')} AS fill_peak_hour, CASE WHEN f IS NOT NULL THEN round_even(list_max(curve), 1) END AS fill_bikes_per_day, {_LABEL.format('d')} AS drain_peak_hour,
    CASE WHEN d IS NOT NULL THEN round_even(-list_min(curve), 1) END AS drain_bikes_per_day FROM (SELECT *, {_FILL.format('curve')} AS f, {_DRAIN.format('curve')} AS d FROM wkday)""")
def _(x):
    p = facts.flow_struct("curve", F.lit(False))
    return x.weekday.select("station_id", *[p[c].alias(c) for c in ("fill_peak_hour", "fill_bikes_per_day", "drain_peak_hour", "drain_bikes_per_day")])


def _pair(x):
    return x.weekday.join(x.curve("weekend").withColumnRenamed("curve", "weekend"), "station_id")


_MOVED = "coalesce(abs(({0}) - ({1})) % 24 >= 2 AND 24 - abs(({0}) - ({1})) % 24 >= 2, false)"


@query("f10_fn_weekend_differs", f"""SELECT station_id, CASE WHEN sqrt(list_sum([v * v for v in c])) >= 0.05 THEN {_MOVED.format(_FILL.format('c'), _FILL.format('w'))} OR {_MOVED.format(_DRAIN.format('c'), _DRAIN.format('w'))} END AS differs
    FROM (SELECT station_id, a.curve AS c, b.curve AS w FROM wkday a JOIN wkend b USING (station_id))""")
def _(x):
    p = _pair(x).withColumn("low", S.l2_norm("curve") < 0.05)
    return p.select("station_id", S.weekend_differs("curve", "weekend", "low", F.lit(False)).alias("differs"))


_NAME = """CASE WHEN list_max(curve) - list_min(curve) = 0 THEN 'Flat (no rhythm)'
    WHEN (curve[17] + curve[18] + curve[19] + curve[20]) / 4 - (curve[7] + curve[8] + curve[9] + curve[10]) / 4 > (list_max(curve) - list_min(curve)) * CAST(0.15 AS DOUBLE) THEN 'Residential feeder (drains AM, fills PM)'
    WHEN (curve[17] + curve[18] + curve[19] + curve[20]) / 4 - (curve[7] + curve[8] + curve[9] + curve[10]) / 4 < -((list_max(curve) - list_min(curve)) * CAST(0.15 AS DOUBLE)) THEN 'Commuter core (fills AM, drains PM)' ELSE 'Mixed/flat rhythm' END"""


@query("m11_ml_name_cluster", f"SELECT station_id, {_NAME} AS name FROM wkday")
def _(x):
    return x.weekday.select("station_id", typology.name_cluster("curve").alias("name"))


@query("f11_fn_typology_matches", f"""SELECT station_id, CASE WHEN contains(name, 'fills AM') THEN coalesce(f BETWEEN 5 AND 11 AND d >= 12, false) WHEN contains(name, 'drains AM') THEN coalesce(d BETWEEN 5 AND 11 AND f >= 12, false) END AS matches
    FROM (SELECT station_id, {_NAME} AS name, {_FILL.format('curve')} AS f, {_DRAIN.format('curve')} AS d FROM wkday)""")
def _(x):
    n = x.weekday.withColumn("name", typology.name_cluster("curve"))
    return n.select("station_id", S.typology_matches("name", "curve", F.lit(False)).alias("matches"))


@query("f12_fn_window_labels", "SELECT strftime(min(o_orderdate), '%b %Y') || ' – ' || strftime(max(o_orderdate), '%b %Y') AS label FROM orders")
def _(x):
    return x.table("orders", "o_orderdate").agg(facts.window_label(F.min("o_orderdate"), F.max("o_orderdate")).alias("label"))


@query("f13_fn_ordinal", """SELECT o_orderkey, format('{:,}', o_orderkey) || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM orders""")
def _(x):
    return x.table("orders", "o_orderkey").select("o_orderkey", S.ordinal("o_orderkey").alias("label"))


@query("f14_fn_fmt", "SELECT o_orderkey, format('{:,}', o_orderkey) AS n, strftime(o_orderdate, '%b %-d, %Y') AS day FROM orders")
def _(x):
    return x.table("orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.format_number("o_orderkey", 0).alias("n"), F.date_format("o_orderdate", "MMM d, yyyy").alias("day"))


@query("f23_fn_normalize_name", "SELECT p_partkey, trim(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def _(x):
    return x.table("part", "p_partkey", "p_name").select("p_partkey", S.normalize_name("p_name").alias("name"))


@query("f24_fn_custom_id", "SELECT station_id, 's' || lpad(CAST(row_number() OVER (ORDER BY station_id) - 1 AS VARCHAR), 5, '0') AS custom_id FROM stations")
def _(x):
    numbered = ordered(x.stations.select("station_id"), ["station_id"], number="place")
    return numbered.select("station_id", F.concat(F.lit("s"), F.lpad((F.col("place") - 1).cast("string"), 5, "0")).alias("custom_id"))


@query("f27_fn_cost", "SELECT p_partkey, round_even(p_size * 3.0 / 1000000 + p_partkey * 15.0 / 1000000, 6) AS cost FROM part")
def _(x):
    return x.table("part", "p_partkey", "p_size").select("p_partkey", F.bround(F.col("p_size") * F.lit(3.0) / 1e6 + F.col("p_partkey") * F.lit(15.0) / 1e6, 6).alias("cost"))


@query("w1_win_competition_rank", "SELECT station_id, unusable_rate, CAST(rank() OVER (ORDER BY unusable_rate DESC) AS INT) AS rank FROM rel WHERE n_observations >= 20")
def _(x):
    return facts.rank_unusable(A.by_station(x.snapshots))


@query("w2_win_spearman", """SELECT round_even(corr(ra, rb), 9) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY capacity) + (count(*) OVER (PARTITION BY capacity) - 1) / 2 AS ra,
    rank() OVER (ORDER BY unusable_rate) + (count(*) OVER (PARTITION BY unusable_rate) - 1) / 2 AS rb FROM joined)""")
def _(x):
    return stats.spearman(_joined(x), "capacity", "unusable_rate").select(F.bround("rho", 9).alias("rho"), "n")


@query("w7_top_worst_list", "SELECT station_id, unusable_rate FROM rel JOIN (SELECT station_id FROM near WHERE layer = 'subway' AND dist_m >= 800) USING (station_id) WHERE n_observations >= 20 ORDER BY unusable_rate DESC, station_id LIMIT 10")
def _(x):
    gap = geo.context(x.stations, x.facilities).filter("transit_gap = 1").select("station_id")
    r = A.by_station(x.snapshots).filter(F.col("n_observations") >= C.RANKABLE).join(gap, "station_id")
    return r.orderBy(F.desc("unusable_rate"), "station_id").limit(10).select("station_id", "unusable_rate")


def _joined(x):
    """Rankable stations with their capacity and mean daily events."""
    demand = x.table("events", "props", "ts").select((F.lit(4000) + F.get_json_object("props", "$.k").cast("int")).cast("long").alias("station_id"), F.to_date("ts").alias("d"))
    demand = demand.groupBy("station_id", "d").agg(F.count("*").alias("n")).groupBy("station_id").agg(F.avg("n").alias("demand"))
    r = A.by_station(x.snapshots).filter(F.col("n_observations") >= C.RANKABLE)
    return r.join(x.stations.filter("capacity > 0"), "station_id").join(demand, "station_id").select("station_id", "unusable_rate", "capacity", "demand")


@query("j6_jn_three_way_station", "SELECT station_id, unusable_rate, capacity, round_even(demand, 9) AS demand FROM joined")
def _(x):
    return _joined(x).withColumn("demand", F.bround("demand", 9))


@query("m8_ml_corr", "SELECT round_even(corr(CAST(capacity AS DOUBLE), demand), 9) AS r FROM joined")
def _(x):
    return _joined(x).agg(F.bround(F.corr(F.col("capacity").cast("double"), "demand"), 9).alias("r"))


@query("a23_agg_band_summary", "SELECT band, count(station_id) AS n, round_even(avg(unusable_rate), 9) AS mean_rate FROM (SELECT unnest(['<20', '20-39', '40+']) AS band) LEFT JOIN (SELECT *, CASE WHEN capacity < 20 THEN '<20' WHEN capacity < 40 THEN '20-39' ELSE '40+' END AS band FROM joined) USING (band) GROUP BY band")
def _(x):
    return stats.bands(_joined(x)).withColumn("mean_rate", F.bround("mean_rate", 9))


def _ols_sql(source: str, y: str, a: str, b: str, keys: str, out: str) -> str:
    """Two-regressor least squares in SQL through DuckDB's covariances."""
    g = f"SELECT {keys} count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({y}) AS yy, var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({y}, {a}) AS ya, covar_pop({y}, {b}) AS yb, covar_pop({a}, {b}) AS ab FROM {source} GROUP BY ALL"
    f = f"SELECT *, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS b1, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS b2 FROM ({g})"
    f = f"SELECT *, my - b1 * ma - b2 * mb AS b0, n * (yy - b1 * ya - b2 * yb) / (n - 3) AS s2, 1 - (yy - b1 * ya - b2 * yb) / yy AS r2 AS r2 FROM ({f})".replace(" AS r2 AS r2", " AS r2")
    f = f"SELECT *, sqrt(s2 * bb / n / (aa * bb - ab * ab)) AS se1, sqrt(s2 * aa / n / (aa * bb - ab * ab)) AS se2 FROM ({f})"
    return f"SELECT {out} FROM ({f})"


_R6 = ", ".join(f"round_even({c}, 6) + 0.0 AS {c}" for c in ("b0", "b1", "b2", "se1", "se2", "r2"))


def _rounded(df, *keys):
    return df.select(*keys, "n", *[F.bround(c, 6).alias(c) for c in ("b0", "b1", "b2", "se1", "se2", "r2")])


@query("m1_ml_ols_cov", _ols_sql("panel", "magnitude", "temp_mean_c", "precip_mm", "", f"n, {_R6}"))
def _(x):
    fit = stats.ols(x.panel, "magnitude", ["temp_mean_c", "precip_mm"])
    row = (fit["n"], *[float(b) for b in fit["beta"]], float(fit["cov"][1, 1]) ** 0.5, float(fit["cov"][2, 2]) ** 0.5, float(fit["r2"]))
    return _rounded(x.spark.createDataFrame([row], "n long, b0 double, b1 double, b2 double, se1 double, se2 double, r2 double"))


@query("m2_ml_weather_reg", _ols_sql("panel", "magnitude", "temp_mean_c", "precip_mm", "station_id,", f"station_id, n, {_R6}"))
def _(x):
    return _rounded(stats.regress2(x.panel, "magnitude", "temp_mean_c", "precip_mm", "station_id").filter(F.col("n") >= C.MIN_DAYS), "station_id")


@query("m4_ml_local_slope", "SELECT station_id, round_even(0.2::DOUBLE + 2 * (-0.001)::DOUBLE * capacity, 9) AS slope, round_even(sqrt(0.01::DOUBLE + 4 * capacity * capacity * 0.0001::DOUBLE + 4 * capacity * (-0.0005)::DOUBLE), 9) AS se FROM stations")
def _(x):
    c = F.col("capacity").cast("double")
    return x.stations.select("station_id", F.bround(stats.local_slope(F.lit(0.2), F.lit(-0.001), c), 9).alias("slope"), F.bround(stats.local_slope_se(F.lit(0.01), F.lit(0.0001), F.lit(-0.0005), c), 9).alias("se"))


@query("m5_ml_ci95", _ols_sql("panel", "magnitude", "temp_mean_c", "precip_mm", "station_id,", "station_id, round_even((b1 - 1.96 * se1) / my, 4) + 0.0 AS low, round_even((b1 + 1.96 * se1) / my, 4) + 0.0 AS high"))
def _(x):
    r = stats.regress2(x.panel, "magnitude", "temp_mean_c", "precip_mm", "station_id")
    r = r.join(x.panel.groupBy("station_id").agg(F.avg("magnitude").alias("m")), "station_id")
    low, high = stats.ci95(F.col("b1"), F.col("se1"), F.col("m"))
    return r.select("station_id", low.alias("low"), high.alias("high"))


@query("m7_ml_capacity_reliability", _ols_sql("(SELECT *, CAST(capacity AS DOUBLE) AS cap, ln(1 + demand) AS logd FROM joined)", "unusable_rate", "cap", "logd", "", "n, round_even(b1, 9) + 0.0 AS rate_per_dock, round_even(se1, 9) AS rate_per_dock_se, round_even(-b1 * 2000, 6) + 0.0 AS reliability_gap_points, -b1 * 2000 > 0.5 AS headline"))
def _(x):
    r = stats.capacity_reliability(_joined(x))
    return r.select("n", F.bround("rate_per_dock", 9).alias("rate_per_dock"), F.bround("rate_per_dock_se", 9).alias("rate_per_dock_se"), F.bround("reliability_gap_points", 6).alias("reliability_gap_points"), "headline")


_X20 = f"(SELECT station_id, [v * 20 for v in curve] AS curve FROM wkday)"


@query("m9_ml_shape_matrix", f"""SELECT station_id, round_even(norm, 6) AS strength, norm < 1.0 AS is_low, CAST(i - 1 AS INT) AS hour, CASE WHEN norm >= 1.0 THEN round_even(v / norm, 6) + 0.0 END AS value
    FROM (SELECT station_id, {_NORM} AS norm, unnest(curve) AS v, unnest(range(1, 25)) AS i FROM {_X20})""")
def _(x):
    m = typology.shape_matrix(x.weekday.select("station_id", F.transform("curve", lambda v: v * 20).alias("curve")))
    cell = F.posexplode(F.coalesce("shape", F.array_repeat(F.lit(None).cast("double"), 24)))
    return m.select("station_id", F.bround("strength", 6).alias("strength"), "is_low", cell.alias("hour", "value")).withColumn("value", F.bround("value", 6))


@query("m19_ml_weather_r2", _ols_sql("panel", "magnitude", "temp_mean_c", "precip_mm", "zone,", "zone, round_even(r2, 6) AS r2"))
def _(x):
    return stats.regress2(x.panel, "magnitude", "temp_mean_c", "precip_mm", "zone").select("zone", F.bround("r2", 6).alias("r2"))


_TRAIN = "(SELECT * FROM monthly WHERE month BETWEEN '1995-01' AND '1995-12')"
_T = lambda x: x.monthly.filter(F.col("month").between("1995-01", "1995-12"))


@query("a17_agg_curves_fold", "SELECT station_id, " + ", ".join(f"coalesce(round_even(avg(CASE WHEN hour = {h} THEN net END), 6) + 0.0, 0.0) AS \"{h}\"" for h in range(24)) + " FROM dkeys WHERE day_type = 'weekday' AND month BETWEEN '1995-01' AND '1995-12' GROUP BY station_id")
def _(x):
    d = x.daily.filter((S.day_type("date") == "weekday") & S.month_key("date").between("1995-01", "1995-12"))
    p = d.groupBy("station_id").pivot("hour", flows.HOURS).agg(F.avg("net")).fillna(0.0)
    return p.select("station_id", *[F.bround(F.col(f"`{h}`"), 6).alias(str(h)) for h in flows.HOURS])


@query("a18_agg_naive", f"SELECT station_id, day_type, hour, round_even(sum(net_per_day * n_days) / sum(n_days), 6) + 0.0 AS predicted FROM {_TRAIN} GROUP BY ALL")
def _(x):
    return forecast.naive(_T(x)).withColumn("predicted", F.bround("predicted", 6))


@query("a19_agg_flat", f"SELECT station_id, round_even(sum(net_per_day * n_days) / sum(n_days), 6) + 0.0 AS predicted_flat FROM {_TRAIN} GROUP BY ALL")
def _(x):
    return forecast.flat(_T(x)).withColumn("predicted_flat", F.bround("predicted_flat", 6))


_PRED = f"""SELECT t.*, coalesce(p, q, 0.0) AS predicted FROM (SELECT * FROM dkeys WHERE month = '1996-01') t
    LEFT JOIN (SELECT station_id, day_type, hour, sum(net_per_day * n_days) / sum(n_days) AS p FROM {_TRAIN} GROUP BY ALL) USING (station_id, day_type, hour)
    LEFT JOIN (SELECT station_id, sum(net_per_day * n_days) / sum(n_days) AS q FROM {_TRAIN} GROUP BY ALL) USING (station_id)"""


def _scored(x):
    test = x.daily.withColumns({"month": S.month_key("date"), "day_type": S.day_type("date")}).filter("month = '1996-01'")
    return forecast.predict(test, forecast.naive(_T(x)), forecast.flat(_T(x)))


@query("j5_jn_baseline_fallback", f"SELECT station_id, date, hour, round_even(predicted, 6) + 0.0 AS predicted FROM ({_PRED})", days=("date",))
def _(x):
    return _scored(x).select("station_id", "date", "hour", F.bround("predicted", 6).alias("predicted"))


_KIND = "(SELECT station_id, CASE WHEN list_max(curve) = list_min(curve) THEN 'Flat (no rhythm)' WHEN pm - am > 0.15 * (list_max(curve) - list_min(curve)) THEN 'Residential feeder (drains AM, fills PM)' WHEN am - pm > 0.15 * (list_max(curve) - list_min(curve)) THEN 'Commuter core (fills AM, drains PM)' ELSE 'Mixed/flat rhythm' END AS kind FROM (SELECT *, (curve[7] + curve[8] + curve[9] + curve[10]) / 4 AS am, (curve[17] + curve[18] + curve[19] + curve[20]) / 4 AS pm FROM wkday))"


@query("a20_agg_mae", f"""SELECT CASE WHEN day_type IS NOT NULL THEN 'day_type' WHEN season IS NOT NULL THEN 'season' WHEN kind IS NOT NULL THEN 'typology' ELSE 'overall' END AS grouping, coalesce(day_type, season, kind, 'all') AS value, count(*) AS n, round_even(avg(abs(net - predicted)), 6) AS mae
    FROM (SELECT p.*, kind, 'winter' AS season FROM ({_PRED}) p JOIN {_KIND} USING (station_id)) GROUP BY GROUPING SETS ((), (day_type), (season), (kind))""")
def _(x):
    p = _scored(x).join(x.weekday.select("station_id", typology.name_cluster("curve").alias("kind")), "station_id").withColumn("season", S.season("month"))
    sets = p.groupingSets([[], [F.col("day_type")], [F.col("season")], [F.col("kind")]], "day_type", "season", "kind").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("net") - F.col("predicted"))).alias("mae"))
    grouping = F.when(F.col("day_type").isNotNull(), "day_type").when(F.col("season").isNotNull(), "season").when(F.col("kind").isNotNull(), "typology").otherwise("overall")
    return sets.select(grouping.alias("grouping"), F.coalesce("day_type", "season", "kind", F.lit("all")).alias("value"), "n", F.bround("mae", 6).alias("mae"))


@query("a21_agg_value_counts", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN temp_mean_c BETWEEN 0 AND 20 THEN 'gbm' WHEN temp_mean_c BETWEEN -5 AND 25 THEN 'gam' ELSE 'naive' END AS tier FROM daily JOIN zones USING (station_id) JOIN weather USING (zone, date)) GROUP BY tier")
def _(x):
    return forecast.with_weather(x.daily, x.zones, x.weather).groupBy(S.extrapolation_tier("temp_mean_c", F.lit(0.0), F.lit(20.0)).alias("tier")).agg(F.count("*").alias("n"))


_MONTHS = [f"1995-{m:02d}" for m in range(1, 13)]
_FOLDS = """SELECT fold, count(*) AS n, avg(abs(net - coalesce(p, q, 0.0))) AS mae FROM (SELECT *, month AS fold FROM dkeys WHERE month BETWEEN '1995-01' AND '1995-12') t
    LEFT JOIN (SELECT f.month AS fold, m.station_id, m.day_type, m.hour, sum(net_per_day * n_days) / sum(n_days) AS p FROM (SELECT DISTINCT month FROM monthly) f, monthly m WHERE m.month <> f.month AND m.month BETWEEN '1995-01' AND '1995-12' GROUP BY ALL) USING (fold, station_id, day_type, hour)
    LEFT JOIN (SELECT f.month AS fold, m.station_id, sum(net_per_day * n_days) / sum(n_days) AS q FROM (SELECT DISTINCT month FROM monthly) f, monthly m WHERE m.month <> f.month AND m.month BETWEEN '1995-01' AND '1995-12' GROUP BY ALL) USING (fold, station_id) GROUP BY fold"""


@query("m17_ml_walk_forward", f"SELECT fold, n, round_even(mae, 6) AS mae FROM ({_FOLDS})")
def _(x):
    return forecast.fold_maes(x.monthly, x.daily, _MONTHS).withColumn("mae", F.bround("mae", 6))


@query("a27_agg_season_weighted_mae", f"SELECT CASE WHEN CAST(substr(fold, 6, 2) AS INT) IN (12, 1, 2) THEN 'winter' WHEN CAST(substr(fold, 6, 2) AS INT) <= 5 THEN 'spring' WHEN CAST(substr(fold, 6, 2) AS INT) <= 8 THEN 'summer' ELSE 'fall' END AS season, round_even(sum(mae * n) / sum(n), 6) AS mae FROM ({_FOLDS}) GROUP BY ALL")
def _(x):
    f = forecast.fold_maes(x.monthly, x.daily, _MONTHS)
    return f.groupBy(S.season("fold").alias("season")).agg(F.bround(F.sum(F.col("mae") * F.col("n")) / F.sum("n"), 6).alias("mae"))


_FLAT = """SELECT fold, avg(abs(net - coalesce(q, 0.0))) AS flat FROM (SELECT *, month AS fold FROM dkeys WHERE month BETWEEN '1995-01' AND '1995-12') t
    LEFT JOIN (SELECT f.month AS fold, m.station_id, sum(net_per_day * n_days) / sum(n_days) AS q FROM (SELECT DISTINCT month FROM monthly) f, monthly m WHERE m.month <> f.month AND m.month BETWEEN '1995-01' AND '1995-12' GROUP BY ALL) USING (fold, station_id) GROUP BY fold"""


# the exact null: every choice of signs of the ranks, at most 2^12 of them
@query("m18_ml_wilcoxon", f"""WITH d AS (SELECT fold, round_even(mae, 6) - round_even(flat, 6) AS d FROM ({_FOLDS}) JOIN ({_FLAT}) USING (fold)),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, row_number() OVER (ORDER BY fold) - 1 AS i FROM d WHERE d <> 0),
    t AS (SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS statistic, count(*) AS n FROM r),
    s AS (SELECT g, sum(CASE WHEN (g >> CAST(i AS INT)) & 1 = 1 THEN r ELSE 0 END) AS w FROM (SELECT unnest(range(CAST(pow(2, n) AS BIGINT))) AS g FROM t), r GROUP BY g)
SELECT statistic, round_even(least(1.0, 2 * (SELECT count(*) FILTER (w <= statistic + 1e-9) FROM s) / pow(2, n)), 9) AS p_value FROM t""")
def _(x):
    naive = forecast.fold_maes(x.monthly, x.daily, _MONTHS)
    only_flat = forecast.fold_maes(x.monthly, x.daily, _MONTHS, by_hour=False).select("fold", F.col("mae").alias("flat"))
    rows = naive.join(only_flat, "fold").select(F.bround("mae", 6).alias("a"), F.bround("flat", 6).alias("b")).collect()  # one per fold
    got = stats.wilcoxon([r.a for r in rows], [r.b for r in rows])
    return x.spark.createDataFrame([tuple(map(float, got))] if got else [], "statistic double, p_value double").withColumn("p_value", F.bround("p_value", 9))


_LABELS = f"(SELECT station_id, CASE WHEN {_NORM} < 0.05 THEN -1 ELSE 0 END AS cluster FROM wkday WHERE station_id <> 'N03')"


@query("j12_jn_typology_lookup", f"SELECT station_id, coalesce(cluster, -2) AS cluster FROM wkday LEFT JOIN {_LABELS} USING (station_id)")
def _(x):
    labels = x.weekday.filter("station_id <> 'N03'").select("station_id", F.when(S.l2_norm("curve") < 0.05, -1).otherwise(0).alias("cluster"))
    return typology.with_typology(x.weekday.select("station_id"), labels)


@query("a28_agg_cluster_mean_curve", "SELECT CAST(substr(station_id, 3, 1) AS INT) % 2 AS cluster, CAST(i - 1 AS INT) AS hour, round_even(avg(v), 6) + 0.0 AS mean_value FROM (SELECT station_id, unnest(curve) AS v, unnest(range(1, 25)) AS i FROM wkday) GROUP BY ALL")
def _(x):
    labels = x.weekday.select("station_id", (F.substring("station_id", 3, 1).cast("int") % 2).alias("cluster"))
    return typology.mean_curves(x.weekday, labels).withColumn("mean_value", F.bround("mean_value", 6))


def _spread(x):
    """Weekday curves times 20, so that some stations pass the routing thresholds, with coordinates."""
    at = x.daily.groupBy("station_id").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    return x.weekday.select("station_id", F.transform("curve", lambda v: v * 20).alias("curve")).join(at, "station_id")


_CANDS = "(SELECT station_id, am, CASE WHEN am <= -1.0 THEN 'deficit' ELSE 'surplus' END AS kind, CAST(round_even(abs(am), 0) AS INT) AS magnitude FROM (SELECT station_id, curve[7] * 20 + curve[8] * 20 + curve[9] * 20 + curve[10] * 20 AS am FROM wkday) WHERE am <= -1.0 OR am >= 1.0)"


@query("p21_flt_candidates", f"SELECT station_id, kind, magnitude, round_even(am, 6) AS am_net FROM {_CANDS}")
def _(x):
    return routing.candidates(_spread(x)).select("station_id", "kind", "magnitude", F.bround("am_net", 6).alias("am_net"))


@query("p22_sel_period", "SELECT DISTINCT station_id, period FROM points WHERE period = 'winter'")
def _(x):
    return routing.select_period(x.points, "winter").select("station_id", "period").distinct()


@query("p20_flt_exclusion", "SELECT station_id FROM stations WHERE station_id NOT IN (4003, 4017)")
def _(x):
    out = x.spark.createDataFrame([(4003, "operator site"), (4017, "outside the city")], "station_id long, reason string")
    return x.stations.join(F.broadcast(out), "station_id", "left_anti").select("station_id")  # a fixed short list


@query("j13_jn_changed_only", "SELECT station_id FROM stations WHERE station_id % 3 <> 0 OR capacity > 30")
def _(x):
    now = x.stations.select("station_id", F.col("capacity").cast("string").alias("facts_hash"))
    old = x.stations.filter("station_id % 3 = 0").select("station_id", F.when(F.col("capacity") > 30, "changed").otherwise(F.col("capacity").cast("string")).alias("facts_hash"))
    return facts.changed_only(now, old).select("station_id")


@query("r1_rt_single_tour")
def _(x):
    return routing.route(routing.candidates(_spread(x)))


@query("r2_rt_route_payload")
def _(x):
    return routing.route(routing.candidates(_spread(x)), trucks=3, max_stops=6)


@query("r3_rt_fleet_sweep")
def _(x):
    return routing.fleet_sweep(routing.candidates(_spread(x)), max_stops=4)


@query("r4_rt_marginal")
def _(x):
    return routing.marginal(routing.fleet_sweep(routing.candidates(_spread(x)), max_stops=4))


@query("r5_sc_presets", "SELECT * FROM (VALUES ('rain', 15.6::DOUBLE, 10.2::DOUBLE), ('snow', -2.2::DOUBLE, 7.6::DOUBLE), ('ideal', 22.2::DOUBLE, 0.0::DOUBLE), ('hot', 31.0::DOUBLE, 0.0::DOUBLE)) AS t(id, temp_c, precip_mm)")
def _(x):
    return routing.presets(x.spark)


@query("r6_sc_weather_projection", _ols_sql("panel", "magnitude", "temp_mean_c", "precip_mm", "station_id,", "station_id, round_even(my * (1 + b1 / my * (15.6::DOUBLE - 22.2::DOUBLE) + b2 / my * 10.2::DOUBLE), 6) AS projected"))
def _(x):
    flow = x.panel.groupBy("station_id").agg(F.avg("magnitude").alias("flow")).withColumn("group", F.lit("all"))
    e = stats.regress2(x.panel, "magnitude", "temp_mean_c", "precip_mm", "station_id").join(flow, "station_id").select("station_id", (F.col("b1") / F.col("flow")).alias("e_t"), (F.col("b2") / F.col("flow")).alias("e_p"))
    none = x.spark.createDataFrame([], "group string, e_t double, e_p double")
    return routing.project(flow, e, none, (15.6, 10.2), (22.2, 0.0)).select("station_id", F.bround("projected", 6).alias("projected"))


@query("d1_ds_slice_totals", "SELECT period, day_type, hour, round_even(CAST(sum(abs(k)) AS BIGINT) / 1000, 0) AS out_of_place, round_even(CAST(sum(CASE WHEN k < 0 THEN -k ELSE 0 END) AS BIGINT) / 1000, 0) AS to_move, count(DISTINCT station_id) AS n_stations FROM (SELECT *, CAST(round_even(value * 1000, 0) AS BIGINT) AS k FROM points) GROUP BY ALL")
def _(x):
    return slices.totals(x.points)


@query("d2_ds_five_bucket", """SELECT period, day_type, hour, CASE WHEN value BETWEEN -0.1 AND 0.1 THEN 'near_balanced' WHEN value <= -greatest(e / 2, 0.1) THEN 'big_deficit' WHEN value < 0 THEN 'deficit' WHEN value >= greatest(e / 2, 0.1) THEN 'big_surplus' ELSE 'surplus' END AS bucket,
    count(*) AS n, round_even(max(e), 6) AS scale_end FROM (SELECT * FROM points WHERE grain = 'season') JOIN (SELECT period, day_type, hour, quantile_cont(abs(value), 0.95) AS e FROM points WHERE grain = 'season' GROUP BY ALL) USING (period, day_type, hour) GROUP BY ALL""")
def _(x):
    return slices.buckets(x.points.filter("grain = 'season'"), 0.1).withColumn("scale_end", F.bround("scale_end", 6))


_LIVE = "(SELECT *, bikes_available / capacity AS fill_pct FROM latest JOIN stations USING (station_id) WHERE capacity > 0 AND is_renting = 1 AND is_returning = 1)"
_live = lambda x: slices.live(A.latest(x.snapshots), x.stations)


@query("d3_ds_fill_distribution", f"SELECT CASE WHEN bikes_available = 0 THEN 0 WHEN docks_available = 0 THEN 4 WHEN fill_pct < 1/3 THEN 1 WHEN fill_pct < 2/3 THEN 2 ELSE 3 END AS bucket, count(*) AS n, count(*) FILTER (bikes_available = 0 AND docks_available = 0) AS n_both FROM {_LIVE} GROUP BY ALL")
def _(x):
    return slices.fill_distribution(_live(x))


@query("d4_ds_has_live", f"SELECT station_id FROM {_LIVE}")
def _(x):
    return _live(x).select("station_id")


@query("d5_ds_excluded", f"SELECT (SELECT count(*) FROM stations) - (SELECT count(*) FROM {_LIVE}) AS n_excluded")
def _(x):
    return x.stations.join(_live(x).select("station_id"), "station_id", "left_anti").agg(F.count("*").alias("n_excluded"))


@query("d6_ds_fill_pct", f"SELECT station_id, round_even(fill_pct, 6) AS fill_pct FROM {_LIVE}")
def _(x):
    return _live(x).select("station_id", F.bround("fill_pct", 6).alias("fill_pct"))


@query("d7_ds_equity_disparity", "SELECT round_even((sum(n_unusable) FILTER (dist_m >= 800) / sum(n_observations) FILTER (dist_m >= 800)) / (sum(n_unusable) / sum(n_observations)), 9) AS disparity FROM rel JOIN (SELECT station_id, dist_m FROM near WHERE layer = 'subway') USING (station_id)")
def _(x):
    r = A.by_station(x.snapshots).join(geo.context(x.stations, x.facilities).select("station_id", "transit_gap"), "station_id")
    g = F.col("transit_gap") == 1
    part = F.sum(F.when(g, F.col("n_unusable"))) / F.sum(F.when(g, F.col("n_observations")))
    return r.agg(F.bround(part / (F.sum("n_unusable") / F.sum("n_observations")), 9).alias("disparity"))


# even stations are expected to fill in the morning, odd ones to drain, and one that is not there to fail
@query("o4_spot_direction", """SELECT 'station direction: ' || station_id AS name, CASE WHEN CAST(substr(station_id, 3, 1) AS INT) % 2 = 0 THEN am > 0 AND pm < 0 ELSE am < 0 AND pm > 0 END AS passed
    FROM (SELECT station_id, curve[8] + curve[9] + curve[10] AS am, curve[18] + curve[19] + curve[20] AS pm FROM wkday) UNION ALL SELECT 'station direction: N99', false""")
def _(x):
    odd = F.substring("station_id", 3, 1).cast("int") % 2 == 1
    e = x.weekday.select("station_id", F.when(odd, "drains_am_fills_pm").otherwise("fills_am_drains_pm").alias("expect"))
    e = e.unionByName(x.spark.createDataFrame([("N99", "fills_am_drains_pm")], "station_id string, expect string"))
    return facts.direction_checks(x.weekday, e).select("name", "passed")


@query("o4_spot_holiday", "SELECT 'holiday dip: 1995-07-04' AS name, 1 - a / (b / 2) >= 0.3 AS passed, round_even(1 - a / (b / 2), 6) + 0.0 AS value FROM (SELECT sum(departures_count) FILTER (date = DATE '1995-07-04') AS a, sum(departures_count) FILTER (date IN (DATE '1995-06-27', DATE '1995-07-11')) AS b FROM daily)")
def _(x):
    return facts.holiday_check(x.daily, "1995-07-04", ["1995-06-27", "1995-07-11"])


@query("o4_spot_season", "SELECT 'seasonal amplitude: N05' AS name, s / w >= 1.5 AS passed, round_even(s / w, 6) AS value FROM (SELECT sum(abs(value)) FILTER (period = 'summer') AS s, sum(abs(value)) FILTER (period = 'winter') AS w FROM points WHERE station_id = 'N05' AND grain = 'season' AND day_type = 'weekday')")
def _(x):
    return facts.season_check(flows.curves(x.points.filter("grain = 'season'")), "N05")


@query("o4_spot_presets", "SELECT 'preset temps in observed range' AS name, min(temp_mean_c) <= -2.2 AND max(temp_mean_c) >= 31.0 AS passed, max(temp_mean_c) - min(temp_mean_c) AS value FROM weather")
def _(x):
    return facts.preset_check(x.weather)


_O5 = "SELECT s.station_id, name, 'ok' AS status, round_even(unusable_rate * 100, 1) AS unusable_pct, CAST(rank() OVER (ORDER BY unusable_rate DESC) AS INT) AS rank, subway_nearest FROM stations s JOIN rel USING (station_id) JOIN (SELECT station_id, nearest AS subway_nearest FROM near WHERE layer = 'subway') USING (station_id)"


def _o5(x):
    curve = F.array(*[F.sin(F.col("station_id") + h) for h in range(24)])
    s = x.stations.select("station_id", "name", curve.alias("weekday"), curve.alias("weekend"), F.lit(0).alias("cluster"), F.lit("Mixed/flat rhythm").alias("cluster_name"))
    f = facts.station_facts(s, A.by_station(x.snapshots), geo.context(x.stations, x.facilities), F.lit(0.2))
    return f.select("station_id", "name", "status", "unusable_pct", "rank", "subway_nearest")


@query("o5_facts", _O5)
def _(x):
    return _o5(x)


@query("f15_canonical_hash", f"""SELECT station_id, sha256(CAST(to_json({{'context': {{'nearest_subway': subway_nearest, 'none': NULL, 'tags': [status, name]}}, 'name': name, 'reliability': {{'rank': rank, 'status': status, 'unusable_pct': unusable_pct}}}}) AS VARCHAR)) AS facts_hash FROM ({_O5})""")
def _(x):
    nested = _o5(x).select("station_id", F.struct("unusable_pct", "rank", "status").alias("reliability"), "name",
                           F.struct(F.array("status", "name").alias("tags"), F.lit(None).cast("string").alias("none"), F.col("subway_nearest").alias("nearest_subway")).alias("context"))
    return facts.facts_hash(nested, ["reliability", "name", "context"])

