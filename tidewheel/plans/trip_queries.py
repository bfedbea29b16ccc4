"""Queries of trips and flows: sources, quality, joins, aggregation, set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import flows, forecast, quality
from tidewheel.operators.ordered import quantile
from tidewheel.plans.registry import query
from tidewheel.sources import tables


@query("s6_src_parquet_cols", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 100000", days=("o_orderdate",))
def _(x):
    return x.table("orders", "o_orderkey", "o_orderdate", "o_totalprice").filter("o_totalprice > 100000").drop("o_totalprice")


@query("p1_prj_duration", "SELECT ride_id, duration_s FROM tagged")
def _(x):
    return quality.tag(x.trips).select("ride_id", "duration_s")


@query("p2_flt_duration", "SELECT ride_id FROM tagged WHERE NOT is_short AND NOT is_long")
def _(x):
    return quality.tag(x.trips).filter("NOT is_short AND NOT is_long").select("ride_id")


@query("p3_flt_bbox", "SELECT ride_id FROM clean")
def _(x):
    return x.clean.select("ride_id")


@query("p4_prj_valid_flags", "SELECT ride_id, has_valid_arrival_station, has_valid_departure_station FROM clean")
def _(x):
    return x.clean.select("ride_id", "has_valid_arrival_station", "has_valid_departure_station")


@query("p5_agg_qc_report", """SELECT count(*) AS rows_in, count(*) FILTER (is_short) AS dropped_short, count(*) FILTER (is_long) AS dropped_long,
    count(*) FILTER (NOT is_short AND NOT is_long AND NOT is_inside) AS dropped_bad_location, count(*) FILTER (NOT is_short AND NOT is_long AND is_inside) AS rows_out,
    count(*) FILTER (NOT is_short AND NOT is_long AND is_inside AND NOT has_valid_departure_station) AS missing_start_station,
    count(*) FILTER (NOT is_short AND NOT is_long AND is_inside AND NOT has_valid_arrival_station) AS missing_end_station FROM tagged""")
def _(x):
    return quality.report(x.trips)


# two of the listed suffix ids are put in, one with and one without its base
_SUFFIXED = "CASE WHEN {0} = '4005.05' THEN CASE WHEN ride_id % 2 = 0 THEN '5308.04_' ELSE '5308.04' END WHEN {0} = '4006.05' THEN '6517.08_' ELSE {0} END"


@query("p6_prj_canonical_id", r"""WITH raw AS (SELECT ride_id, """ + _SUFFIXED.format("start_station_id") + """ AS s, end_station_id AS e FROM v_trips), known AS (SELECT s AS id FROM raw UNION SELECT e FROM raw)
SELECT ride_id, CASE WHEN s = '5308.04_' THEN '5308.04' WHEN regexp_full_match(s, '\\d+\\.\\d') AND s || '0' IN (SELECT id FROM known WHERE id IS NOT NULL) THEN s || '0' ELSE s END AS start_station_id,
    CASE WHEN regexp_full_match(e, '\\d+\\.\\d') AND e || '0' IN (SELECT id FROM known WHERE id IS NOT NULL) THEN e || '0' ELSE e END AS end_station_id FROM raw""")
def _(x):
    raw = x.raw_trips.withColumn("start_station_id", F.expr(_SUFFIXED.format("start_station_id")))
    return quality.canonicalize(raw, "start_station_id", "end_station_id").select("ride_id", "start_station_id", "end_station_id")


@query("p7_prj_day_type", "SELECT ride_id, CASE WHEN isodow(started_at) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type FROM v_trips")
def _(x):
    return x.raw_trips.select("ride_id", S.day_type("started_at").alias("day_type"))


@query("p8_prj_side", "SELECT station_id, station_name, moment, lat, lng, sign FROM sides WHERE sign = 1", days=("moment",))
def _(x):
    return flows.side(x.clean, True)


@query("p9_prj_season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'fall' END AS season FROM orders")
def _(x):
    return x.table("orders", "o_orderkey", "o_orderdate").select("o_orderkey", S.season(S.month_key("o_orderdate")).alias("season"))


@query("p10_flt_month_clip", "SELECT station_id, date, hour, net FROM dkeys WHERE month = '1995-03'", days=("date",))
def _(x):
    return x.daily.filter((F.col("date") >= F.lit("1995-03-01").cast("date")) & (F.col("date") < F.lit("1995-04-01").cast("date"))).select("station_id", "date", "hour", "net")


@query("p11_flt_month_in", "SELECT station_id, date, hour, net FROM dkeys WHERE month IN ('1995-03', '1995-04')", days=("date",))
def _(x):
    return x.daily.filter(S.month_key("date").isin("1995-03", "1995-04")).select("station_id", "date", "hour", "net")


def _nth(month: int, n: int) -> str:
    """The n-th Monday of a month."""
    return f"month(t) = {month} AND isodow(t) = 1 AND day(t) BETWEEN {7 * n - 6} AND {7 * n}"


_FIXED = "(month(t), day(t)) IN ((1, 1), (7, 4), (11, 11), (12, 25)) OR (month(t) = 6 AND day(t) = 19 AND year(t) >= 2021)"
_HOLIDAY = f"""({' OR '.join([_nth(1, 3), _nth(2, 3), _nth(9, 1), _nth(10, 2), 'month(t) = 5 AND isodow(t) = 1 AND day(t) >= 25', 'month(t) = 11 AND isodow(t) = 4 AND day(t) BETWEEN 22 AND 28'])}
    OR (isodow(t) <= 5 AND ({_FIXED})) OR (isodow(t) = 5 AND ({_FIXED.replace('(t)', '(t + INTERVAL 1 DAY)')})) OR (isodow(t) = 1 AND ({_FIXED.replace('(t)', '(t - INTERVAL 1 DAY)')})))"""


@query("f26_fn_us_holidays", f"SELECT strftime(t, '%Y-%m-%d') AS holiday FROM (SELECT unnest(generate_series(DATE '1992-01-01', DATE '2026-08-31', INTERVAL 1 DAY)) AS t) WHERE {_HOLIDAY}")
def _(x):
    return x.spark.createDataFrame([(d,) for d in forecast.us_holidays("1992-01-01", "2026-08-31")], "holiday string")


@query("p17_prj_calendar", f"""SELECT station_id, date, hour, strftime(date, '%Y-%m') AS month, CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, dayname(date) AS day_of_week, is_holiday,
    round_even(sin(dayofyear(date) * (2 * pi() / 365.25)), 6) + 0.0 AS doy_sin, round_even(cos(dayofyear(date) * (2 * pi() / 365.25)), 6) + 0.0 AS doy_cos,
    round_even(sin(hour * (2 * pi() / 24)), 6) + 0.0 AS hour_sin, round_even(cos(hour * (2 * pi() / 24)), 6) + 0.0 AS hour_cos FROM daily JOIN (SELECT date, {_HOLIDAY} AS is_holiday FROM (SELECT DISTINCT date, date AS t FROM daily)) USING (date)""", days=("date",))
def _(x):
    c = forecast.calendar(x.daily.select("station_id", "date", "hour"), forecast.us_holidays("1990-01-01", "2030-12-31"))
    return c.select("station_id", "date", "hour", "month", "day_type", "day_of_week", "is_holiday", *[F.bround(n, 6).alias(n) for n in ("doy_sin", "doy_cos", "hour_sin", "hour_cos")])


@query("p18_prj_precip_bin", "SELECT date, zone, CASE WHEN precip_mm <= 0.1 THEN 'dry' WHEN precip_mm <= 5 THEN 'light' WHEN precip_mm <= 20 THEN 'moderate' ELSE 'heavy' END AS bin FROM weather", days=("date",))
def _(x):
    return x.weather.select("date", "zone", S.precip_bin("precip_mm").alias("bin"))


@query("p19_prj_extrap_tier", "SELECT date, zone, CASE WHEN temp_mean_c BETWEEN 0 AND 20 THEN 'gbm' WHEN temp_mean_c BETWEEN -5 AND 25 THEN 'gam' ELSE 'naive' END AS tier FROM weather", days=("date",))
def _(x):
    return x.weather.select("date", "zone", S.extrapolation_tier("temp_mean_c", F.lit(0.0), F.lit(20.0)).alias("tier"))


@query("j1_jn_left_ndays", "SELECT station_id, station_name, month, day_type, hour, net, n_days FROM net_m LEFT JOIN ndays USING (month, day_type)")
def _(x):
    return flows.net_flow(x.clean).select("station_id", "station_name", "month", "day_type", "hour", "net", "n_days")


@query("j2_jn_full_outer_components", """SELECT station_id, station_name, date, hour, coalesce(a.net, 0) AS arrivals_count, coalesce(-d.net, 0) AS departures_count, coalesce(a.net, 0) + coalesce(d.net, 0) AS net,
    coalesce(a.lat, d.lat) AS lat, coalesce(a.lng, d.lng) AS lng FROM (SELECT * FROM side_d WHERE sign = 1) a FULL JOIN (SELECT * FROM side_d WHERE sign = -1) d USING (station_id, station_name, date, hour)""", days=("date",))
def _(x):
    return flows.daily_components(x.clean)


@query("j3_jn_weather_inner", "SELECT station_id, date, hour, net, zone, temp_mean_c, precip_mm FROM daily JOIN zones USING (station_id) JOIN weather USING (zone, date)", days=("date",))
def _(x):
    return forecast.with_weather(x.daily, x.zones, x.weather).select("station_id", "date", "hour", "net", "zone", "temp_mean_c", "precip_mm")


@query("j4_jn_map_lookup", "SELECT zone, CAST(sum(net) AS BIGINT) AS net, count(*) AS n FROM daily JOIN zones USING (station_id) GROUP BY zone")
def _(x):
    return x.daily.join(x.zones, "station_id").groupBy("zone").agg(F.sum("net").alias("net"), F.count("*").alias("n"))


@query("j9_jn_meta_back", """SELECT station_id, date, hour, s.net, name FROM (SELECT station_id, date, hour, CAST(sum(net) AS BIGINT) AS net FROM daily GROUP BY ALL) s
    LEFT JOIN (SELECT station_id, min(station_name) AS name FROM daily GROUP BY station_id) m USING (station_id)""", days=("date",))
def _(x):
    s = x.daily.groupBy("station_id", "date", "hour").agg(F.sum("net").alias("net"))
    return s.join(x.daily.groupBy("station_id").agg(F.min("station_name").alias("name")), "station_id", "left")


@query("a1_agg_side_monthly", "SELECT station_id, station_name, month, day_type, hour, net, lat, lng FROM side_m WHERE sign = -1")
def _(x):
    return flows.side_monthly(x.clean, False).drop("sign")


@query("a2_agg_side_daily", "SELECT station_id, station_name, date, hour, net, lat, lng FROM side_d WHERE sign = 1", days=("date",))
def _(x):
    return flows.side_daily(x.clean, True).drop("sign")


@query("a3_agg_distinct_dates", "SELECT * FROM ndays")
def _(x):
    return flows.days_per_bucket(x.clean)


@query("a4_agg_net_flow", "SELECT net_m.*, n_days, round_even(net / greatest(n_days, 1), 3) + 0.0 AS net_per_day FROM net_m LEFT JOIN ndays USING (month, day_type)")
def _(x):
    return flows.net_flow(x.clean)


@query("a5_agg_throughput", """SELECT t.*, n_days, round_even(count / greatest(n_days, 1), 3) AS throughput_per_day FROM (SELECT station_id, month, day_type, hour, count(*) AS count FROM sides GROUP BY ALL) t
    LEFT JOIN ndays USING (month, day_type)""")
def _(x):
    return flows.throughput(x.clean)


@query("a6_agg_daily_net", "SELECT station_id, station_name, date, hour, CAST(sum(net) AS BIGINT) AS net, median(lat) AS lat, median(lng) AS lng FROM side_d GROUP BY ALL", days=("date",))
def _(x):
    return flows.daily_net(x.clean)


@query("a7_agg_weighted_curve", "SELECT station_id, grain, period, day_type, hour, value FROM points")
def _(x):
    return x.points


@query("a7_curve_arrays", "SELECT station_id, array_to_string(curve, ' ') AS curve FROM (SELECT station_id, [CAST(round_even(v * 1000, 0) AS BIGINT) for v in curve] AS curve FROM wkday)")
def _(x):
    whole = F.transform("curve", lambda v: F.bround(v * 1000, 0).cast("bigint").cast("string"))
    return x.weekday.select("station_id", F.array_join(whole, " ").alias("curve"))


@query("a8_agg_daily_to_monthly", "SELECT station_id, station_name, month, day_type, hour, net, lat, lng, n_days, net_per_day FROM monthly")
def _(x):
    return x.monthly


@query("a9_agg_coverage", "SELECT station_id, array_to_string(list_sort(list(DISTINCT month)), ',') AS months, CAST(count(DISTINCT month) AS INT) AS n_months FROM dkeys GROUP BY station_id")
def _(x):
    return flows.coverage(x.daily.withColumn("month", S.month_key("date"))).withColumn("months", F.array_join("months", ","))


@query("a10_agg_repair_daily", r"""WITH rows AS (SELECT station_id, station_name, date, hour, lat, lng, CASE WHEN sign = 1 THEN 1 ELSE 0 END AS a, sign FROM (SELECT * FROM (
        SELECT end_station_id AS station_id, end_station_name AS station_name, CAST(ended_at AS DATE) AS date, CAST(hour(ended_at) AS INT) AS hour, end_lat AS lat, end_lng AS lng, 1 AS sign FROM v_trips
        UNION ALL SELECT start_station_id, start_station_name, CAST(started_at AS DATE), CAST(hour(started_at) AS INT), start_lat, start_lng, -1 FROM v_trips) WHERE station_id IS NOT NULL AND station_name IS NOT NULL)),
    own AS (SELECT station_id, station_name FROM (SELECT station_id, station_name, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, station_name) AS rn FROM (SELECT DISTINCT station_id, station_name, date, hour FROM rows) GROUP BY station_id, station_name) WHERE rn = 1)
SELECT m.station_id, date, hour, CAST(sum(a) AS BIGINT) AS arrivals_count, CAST(sum(1 - a) AS BIGINT) AS departures_count, CAST(sum(sign) AS BIGINT) AS net, own.station_name
    FROM (SELECT coalesce(canonical, station_id) AS station_id, date, hour, a, sign FROM rows LEFT JOIN cmap ON station_id = id) m LEFT JOIN own ON m.station_id = own.station_id GROUP BY ALL""", days=("date",))
def _(x):
    daily = flows.daily_components(x.raw_trips)
    return flows.repair(daily, ["2024-01", "2024-02"]).drop("lat", "lng")


@query("a11_agg_magnitude", "SELECT station_id, date, round_even(avg(abs(net)), 6) AS magnitude FROM daily GROUP BY ALL", days=("date",))
def _(x):
    return x.daily.groupBy("station_id", "date").agg(F.bround(F.avg(F.abs("net")), 6).alias("magnitude"))


@query("a12_agg_station_throughput", "SELECT station_id, round_even(avg(n), 6) AS throughput FROM (SELECT station_id, date, sum(arrivals_count + departures_count) AS n FROM daily GROUP BY ALL) GROUP BY station_id")
def _(x):
    day = x.daily.groupBy("station_id", "date").agg(F.sum(F.col("arrivals_count") + F.col("departures_count")).alias("n"))
    return day.groupBy("station_id").agg(F.bround(F.avg("n"), 6).alias("throughput"))


@query("a22_agg_station_coords", "SELECT station_id, median(lat) AS lat, median(lng) AS lng FROM daily GROUP BY station_id")
def _(x):
    return x.daily.groupBy("station_id").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng"))


@query("a25_agg_daily_totals", "SELECT date, CAST(sum(departures_count) AS BIGINT) AS departures FROM daily GROUP BY date", days=("date",))
def _(x):
    return x.daily.groupBy("date").agg(F.sum("departures_count").alias("departures"))


_S = "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' WHEN month(date) <= 8 THEN 'summer' ELSE 'fall' END"


@query("a26_agg_season_amplitude", f"SELECT {_S} AS season, round_even(avg(abs(net)), 6) AS amplitude, count(DISTINCT date) AS n_dates FROM daily GROUP BY ALL")
def _(x):
    return x.daily.groupBy(S.season(S.month_key("date")).alias("season")).agg(F.bround(F.avg(F.abs("net")), 6).alias("amplitude"), F.countDistinct("date").alias("n_dates"))


# 2 * s / sqrt(n) < |mean| and |mean| >= 1 in whole numbers, so that no rounding decides an edge; s is the sample's
@query("a29_agg_sign_confidence", f"""SELECT grain, count(*) FILTER (abs(t) >= k) AS n, count(*) FILTER (abs(t) >= k AND t * t * (k - 1) > 4 * (k * q - t * t)) AS n_sure FROM (
    SELECT CASE WHEN month IS NOT NULL THEN 'month' WHEN season IS NOT NULL THEN 'season' ELSE 'all' END AS grain, station_id, day_type, CAST(sum(v) AS BIGINT) AS t, CAST(sum(v * v) AS BIGINT) AS q, count(*) AS k
    FROM (SELECT station_id, month, {_S} AS season, day_type, date, sum(net) AS v FROM dkeys GROUP BY ALL)
    GROUP BY GROUPING SETS ((station_id, day_type), (station_id, day_type, season), (station_id, day_type, month))) GROUP BY grain""")
def _(x):
    day = x.daily.groupBy("station_id", S.month_key("date").alias("month"), S.day_type("date").alias("day_type"), "date").agg(F.sum("net").alias("v")).withColumn("season", S.season("month"))
    keys = [F.col("station_id"), F.col("day_type")]
    b = day.groupingSets([keys, [*keys, F.col("season")], [*keys, F.col("month")]], "station_id", "day_type", "season", "month").agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("k"))
    big, tt = F.abs("t") >= F.col("k"), F.col("t") * F.col("t")
    grain = F.when(F.col("month").isNotNull(), "month").when(F.col("season").isNotNull(), "season").otherwise("all")
    return b.groupBy(grain.alias("grain")).agg(F.count_if(big).alias("n"), F.count_if(big & (tt * (F.col("k") - 1) > 4 * (F.col("k") * F.col("q") - tt))).alias("n_sure"))


@query("a30_agg_missing_by_type", "SELECT count(*) AS n_missing, count(*) FILTER (rideable_type = 'electric_bike') / count(*) AS electric_share FROM clean WHERE end_station_id IS NULL")
def _(x):
    return x.clean.filter("end_station_id IS NULL").agg(F.count("*").alias("n_missing"), (F.count_if(F.col("rideable_type") == "electric_bike") / F.count("*")).alias("electric_share"))


@query("a31_agg_quantile_clip", "SELECT ride_id, round_even(least(duration_s, (SELECT quantile_cont(duration_s, 0.99) FROM clean)), 6) AS clipped_s FROM clean")
def _(x):
    top = quantile(x.clean, "duration_s", 0.99, name="top")
    return x.clean.join(F.broadcast(top)).select("ride_id", F.bround(F.least("duration_s", "top"), 6).alias("clipped_s"))  # one row


@query("a32_agg_observed_range", "SELECT min(temp_mean_c) AS low, max(temp_mean_c) AS high FROM weather")
def _(x):
    return x.weather.agg(F.min("temp_mean_c").alias("low"), F.max("temp_mean_c").alias("high"))


@query("u1_set_union_all", "SELECT sign, count(*) AS n FROM sides GROUP BY sign")
def _(x):
    return flows.sides(x.clean).groupBy("sign").agg(F.count("*").alias("n"))


@query("u2_set_distinct", "SELECT DISTINCT station_id, month FROM dkeys")
def _(x):
    return x.daily.select("station_id", S.month_key("date").alias("month")).distinct()


@query("u3_set_replace_window", "SELECT station_id, date, hour, net FROM dkeys WHERE month NOT IN ('1995-03') UNION ALL SELECT station_id, date, hour, net FROM dkeys WHERE month = '1995-04'", days=("date",))
def _(x):
    d = x.daily.select("station_id", "date", "hour", "net")
    return flows.replace_months(d, d.filter(S.month_key("date") == "1995-04"), ["1995-03"])


@query("u4_set_difference", "SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(x):
    c = x.table("customer", "c_nationkey").select(F.col("c_nationkey").alias("nation")).distinct()
    s = x.table("supplier", "s_nationkey", "s_acctbal").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return c.join(s, "nation", "left_anti")


@query("u5_set_union_distinct_ids", "SELECT id FROM ids")
def _(x):
    return x.raw_trips.select(F.explode(F.array("start_station_id", "end_station_id")).alias("id")).filter("id IS NOT NULL").distinct()


@query("w5_srt_canonical", "SELECT station_id, date, hour, net FROM daily ORDER BY station_id, date, hour", days=("date",))
def _(x):
    return x.daily.select("station_id", "date", "hour", "net").orderBy("station_id", "date", "hour")


@query("w8_top_concentration", """SELECT CAST(sum(CASE WHEN rn <= 20 THEN m ELSE 0 END) AS BIGINT) AS top_deficit, CAST(sum(m) AS BIGINT) AS total_deficit FROM (
    SELECT magnitude AS m, row_number() OVER (ORDER BY magnitude DESC, station_id) AS rn FROM cands WHERE kind = 'deficit')""")
def _(x):
    from tidewheel.operators import routing

    c = routing.candidates(x.weekday).filter("kind = 'deficit'").select(F.col("magnitude").cast("long").alias("m"), "station_id")
    top = c.orderBy(F.desc("m"), "station_id").limit(20).agg(F.sum("m").alias("top_deficit"))
    return top.join(c.agg(F.sum("m").alias("total_deficit")))  # one-row frames


@query("w10_split_recent", """SELECT date, count(*) AS n, i >= floor(k * 0.85) AS is_validation FROM daily JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT date FROM daily)) USING (date) GROUP BY ALL""", days=("date",))
def _(x):
    return forecast.split_recent(x.daily.select("date")).groupBy("date", "is_validation").agg(F.count("*").alias("n"))


def flagship(spark, sf_dir):
    """Quality-controlled hourly net flow."""
    trips = quality.canonicalize(tables.view(spark, sf_dir, "v_trips"), "start_station_id", "end_station_id")
    return flows.net_flow(quality.clean(trips))
