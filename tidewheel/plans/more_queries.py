"""Queries of raw records, sinks, models, text and streams."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.functions import briefs, scalars as S
from tidewheel.operators import availability as A, elasticity, facts, flows, forecast, geo, typology
from tidewheel.plans.registry import query
from tidewheel.session import cut, prepare_workers, shared_dir
from tidewheel.sources import facilities, files
from tidewheel.streaming import availability as live

_RAW = """(SELECT p_name AS location_name, CASE WHEN p_size % 3 = 0 THEN 'Open' ELSE 'Closed' END AS status_descriptions,
    CASE WHEN p_partkey % 7 = 0 THEN 'NULL' WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(40 + p_size AS VARCHAR) END AS latitude, CAST(-p_size AS VARCHAR) AS longitude, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS stop_name FROM part)"""


def _raw(x):
    p = x.table("part", "p_partkey", "p_name", "p_size")
    lat = F.when(F.col("p_partkey") % 7 == 0, "NULL").when(F.col("p_partkey") % 11 == 0, "").otherwise((40 + F.col("p_size")).cast("string"))
    return p.select(F.col("p_name").alias("location_name"), F.when(F.col("p_size") % 3 == 0, "Open").otherwise("Closed").alias("status_descriptions"), lat.alias("latitude"),
                    (-F.col("p_size")).cast("string").alias("longitude"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("stop_name"))


@query("p14_flt_open_school", f"SELECT location_name AS name, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lng FROM {_RAW} WHERE status_descriptions = 'Open' AND TRY_CAST(latitude AS DOUBLE) IS NOT NULL")
def _(x):
    return facilities.open_schools(_raw(x))


@query("p15_flt_subway_coord", f"SELECT coalesce(stop_name, '') AS name, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lng FROM {_RAW} WHERE TRY_CAST(latitude AS DOUBLE) IS NOT NULL")
def _(x):
    return facilities.subway_entrances(_raw(x))


@query("p16_prj_polygon_centroid", "SELECT name, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng FROM stations")
def _(x):
    r = 0.001
    ring = F.array(*[F.array(F.col("lng") + F.lit(a * r), F.col("lat") + F.lit(b * r)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    h = facilities.housing(x.stations.select("name", F.array(F.array(ring)).alias("geometry")))
    return h.select("name", F.bround("lat", 6).alias("lat"), F.bround("lng", 6).alias("lng"))


@query("s9_snk_parquet", "SELECT month, count(*) AS n, CAST(sum(net) AS BIGINT) AS net FROM dkeys GROUP BY month")
def _(x):
    path = f"{shared_dir(x.spark)}/tidewheel/daily-{uuid.uuid4().hex}"
    files.write_daily(x.daily, path)
    return x.spark.read.parquet(path).withColumn("month", F.date_format("date", "yyyy-MM")).groupBy("month").agg(F.count("*").alias("n"), F.sum("net").alias("net"))


@query("s10_snk_json_doc", "SELECT station_id, count(DISTINCT period) FILTER (grain = 'season') AS n_seasons, count(DISTINCT period) FILTER (grain = 'month') AS n_months FROM points GROUP BY station_id")
def _(x):
    at = x.daily.groupBy("station_id").agg(F.min("station_name").alias("name"), F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    path = f"{shared_dir(x.spark)}/tidewheel/stations-{uuid.uuid4().hex}"
    files.write_documents(files.station_documents(flows.curves(x.points), at), path)
    pair = "map<string, struct<weekday: array<double>, weekend: array<double>>>"
    d = x.spark.read.schema(f"station_id string, weekday array<double>, weekend array<double>, seasons {pair}, months {pair}").json(path)
    return d.select("station_id", F.size("seasons").cast("long").alias("n_seasons"), F.size("months").cast("long").alias("n_months"))


@query("s11_snk_csv_append_daily", "SELECT CAST(CAST(observed_at AS DATE) AS VARCHAR) AS utc_date, count(*) AS n FROM v_snapshots GROUP BY ALL")
def _(x):
    path = f"{shared_dir(x.spark)}/tidewheel/log-{uuid.uuid4().hex}"
    cols = [F.col(c).cast("int") for c in ("bikes_available", "docks_available", "is_renting", "is_returning")]
    rows = x.snapshots.select(F.col("station_id").cast("string"), F.col("observed_at").cast("timestamp").alias("timestamp"), *cols)
    files.append_snapshots(rows.filter("is_renting = 1"), path)
    files.append_snapshots(rows.filter("is_renting <> 1"), path)
    return x.spark.read.option("header", True).csv(path).groupBy(F.col("utc_date").cast("string").alias("utc_date")).agg(F.count("*").alias("n"))


def _facts(x):
    curve = lambda k: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.bround(F.sin((h + F.col("station_id") * k) / 4) * 3, 3))
    s = x.stations.select("station_id", "name", curve(1).alias("weekday"), curve(2).alias("weekend"))
    s = s.withColumns({"cluster": F.when(F.col("station_id") % 9 == 0, -1).otherwise(0), "cluster_name": typology.name_cluster("weekday")})
    rate = A.system(x.snapshots).first()["unusable_rate"]
    return facts.station_facts(s, A.by_station(x.snapshots), geo.context(x.stations, x.facilities), F.lit(rate))


def _records(f):
    """Facts in the nested form that texts are written from: (station_id, and the record's fields)."""
    near = lambda flag, name: F.when(F.col(flag) == 1, F.col(name))
    context = F.struct(
        F.col("subway_nearest").alias("nearest_subway"), F.col("subway_dist_m").alias("subway_distance_m"), (F.col("near_housing") == 1).alias("near_nycha"), near("near_housing", "housing_nearest").alias("nycha_name"),
        (F.col("near_school") == 1).alias("near_school"), near("near_school", "school_nearest").alias("school_name"), (F.col("transit_gap") == 1).alias("transit_gap"),
        F.lit(C.NEAR_HOUSING_M).alias("nycha_threshold_m"), F.lit(C.NEAR_SCHOOL_M).alias("school_threshold_m"), F.lit(C.TRANSIT_GAP_M).alias("transit_gap_threshold_m"))
    reliability = F.struct("status", "unusable_pct", "rank", "n_ranked", "system_unusable_pct")
    return f.select("station_id", "name", "typology", "typology_matches_peak", "weekday_flow", "weekend_flow", "weekend_differs", reliability.alias("reliability"), context.alias("context"))


def _as_record(f):
    r = _records(f)
    return r.select("station_id", F.to_json(F.struct(*[c for c in r.columns if c != "station_id"]), {"ignoreNullFields": "false"}).alias("record"))


@query("f15_fn_facts_hash")
def _(x):
    r = _records(_facts(x))
    return facts.facts_hash(r, [c for c in r.columns if c != "station_id"])


@query("w9_samp_round_robin")
def _(x):
    return x.spark.createDataFrame([(i, s) for i, s in enumerate(briefs.sample(_as_record(_facts(x)), 20))], "position int, station_id string")


@query("f21_fn_template_text")
def _(x):
    r = _records(_facts(x))
    r = r.select("station_id", F.struct(*[c for c in r.columns if c != "station_id"]).alias("record"))
    kind, record = r.schema["record"].dataType, F.col("record")
    written = r.withColumn("text", briefs.plain_text(record, kind))
    return written.select("station_id", "text", briefs.violations(F.col("text"), record, kind).alias("violations"))


def _roster(x):
    """Stations of the daily table: curves twenty times as high (their flows are small), type by curve, capacity of the station of that number, trips a day."""
    curve = x.weekday.select("station_id", F.transform("curve", lambda v: v * 20).alias("curve"))
    day = x.daily.groupBy("station_id", "date").agg(F.sum(F.col("arrivals_count") + F.col("departures_count")).alias("n")).groupBy("station_id").agg(F.avg("n").alias("throughput"))
    capacity = x.stations.select((F.col("station_id") - 4000).alias("k"), "capacity")
    k = F.expr("try_cast(substr(station_id, 2) AS bigint)")
    s = curve.withColumn("k", k).join(capacity, "k", "left").join(day, "station_id", "left")
    return s.select("station_id", typology.name_cluster("curve").alias("cluster_name"), S.mean_abs("curve").alias("magnitude"), "capacity", "throughput")


_ROSTER = """(SELECT station_id, list_sum([abs(v * 20) for v in curve]) / 24 AS y, CAST(capacity AS DOUBLE) AS a, CAST(capacity * capacity AS DOUBLE) AS b, throughput AS c FROM wkday
    JOIN (SELECT station_id - 4000 AS k, capacity FROM stations) ON k = CAST(substr(station_id, 2) AS BIGINT) JOIN (SELECT station_id, avg(n) AS throughput FROM (SELECT station_id, date, sum(arrivals_count + departures_count) AS n FROM daily GROUP BY ALL) GROUP BY station_id) USING (station_id))"""


# each regressor is cleared of those before it, then y is regressed on what is left, last to first
@query("m3_ml_capacity_curve", f"""WITH r AS {_ROSTER}, r1 AS (SELECT *, a - avg(a) OVER () AS p FROM r),
    r2 AS (SELECT *, b - avg(b) OVER () - p * sum(b * p) OVER () / sum(p * p) OVER () AS q, sum(b * p) OVER () / sum(p * p) OVER () AS bp FROM r1),
    r3 AS (SELECT *, c - avg(c) OVER () - p * sum(c * p) OVER () / sum(p * p) OVER () - q * sum(c * q) OVER () / sum(q * q) OVER () AS s, sum(c * p) OVER () / sum(p * p) OVER () AS cp, sum(c * q) OVER () / sum(q * q) OVER () AS cq FROM r2),
    f AS (SELECT sum(y * s) / sum(s * s) AS b3, sum(y * q) / sum(q * q) AS yq, sum(y * p) / sum(p * p) AS yp, any_value(bp) AS bp, any_value(cp) AS cp, any_value(cq) AS cq, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM r3),
    g AS (SELECT *, yq - b3 * cq AS b2 FROM f), h AS (SELECT *, yp - b2 * bp - b3 * cp AS b1 FROM g)
SELECT term, round_even(coefficient, 6) + 0.0 AS coefficient FROM (SELECT 'intercept' AS term, my - b1 * ma - b2 * mb - b3 * mc AS coefficient FROM h UNION ALL SELECT 'capacity', b1 FROM h UNION ALL SELECT 'capacity2', b2 FROM h UNION ALL SELECT 'throughput', b3 FROM h)""")
def _(x):
    curve = elasticity.capacity_curve(_roster(x))
    rows = [] if curve is None else [(t, float(b)) for t, b in zip(("intercept", "capacity", "capacity2", "throughput"), curve["beta"])]
    return x.spark.createDataFrame(rows, "term string, coefficient double").withColumn("coefficient", F.bround("coefficient", 6))


@query("m6_ml_elasticities")
def _(x):
    types, stations = elasticity.elasticities(_roster(x), x.panel)
    types = types.withColumns({"level": F.lit("typology"), "key": F.col("cluster_name")})
    return types.unionByName(stations.withColumns({"level": F.lit("station"), "key": F.col("station_id")}), allowMissingColumns=True)


def _shapes(x):
    """Shapes at the operator's own threshold, of curves twenty times as high."""
    return typology.shape_matrix(x.weekday.select("station_id", F.transform("curve", lambda v: v * 20).alias("curve")))


@query("m10_ml_select_k")
def _(x):
    k, _, scores = typology.select_k(_shapes(x))
    return x.spark.createDataFrame([(i, float(s), i == k) for i, s in scores.items()], "k int, silhouette double, chosen boolean")


@query("m12_ml_typology")
def _(x):
    shapes = _shapes(x)
    return typology.assign(shapes, typology.select_k(shapes)[1]).select("station_id", "cluster_name")


FOLD_MONTH = "1996-01"
_HOLIDAYS = ("1990-01-01", "2030-12-31")


def _fold(x):
    """(every other month, the month held out), with every feature."""
    daily = cut(x.daily)  # read by the typology and the features
    labels = typology.refit(daily.filter(S.month_key("date") != FOLD_MONTH), 20.0)
    d = forecast.fold_frame(daily, x.zones, x.weather, forecast.us_holidays(*_HOLIDAYS), labels)
    return d.filter(F.col("month") != FOLD_MONTH), d.filter(F.col("month") == FOLD_MONTH)


@query("m13_ml_gam")
def _(x):
    train, test = _fold(x)
    models, out = forecast.gam_many(train, {"departures_count": True, "arrivals_count": True, "net": False}), None
    for target, model in models.items():
        p = model(test)
        p = p.groupBy("day_type").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(target) - F.col("gam"))).alias("mae")).withColumn("target", F.lit(target))
        out = p if out is None else out.unionByName(p)
    return out


@query("m14_ml_gbm")
def _(x):
    train, test = _fold(x)
    p = forecast.gbm(train, "departures_count")(test)
    return p.groupBy("day_type").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("departures_count") - F.col("gbm"))).alias("mae"))


def _run_fold(x):
    return cut(forecast.run_fold(x.daily, FOLD_MONTH, x.zones, x.weather, forecast.us_holidays(*_HOLIDAYS), scale=20.0))


@query("m15_ml_recombine_guard")
def _(x):
    p = _run_fold(x)
    own = F.when(F.col("tier") == "gbm", F.col("gbm")).when(F.col("tier") == "gam", F.col("gam")).otherwise(F.col("predicted"))
    return p.groupBy("tier").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("net") - F.col("guarded"))).alias("mae"), F.count_if(F.col("guarded") == own).alias("n_routed"))


@query("m16_ml_run_fold")
def _(x):
    return forecast.fold_scores(_run_fold(x))


def _stream(x):
    """The event table as a stream, in the snapshot form."""
    raw = x.spark.readStream.schema(x.table("events").schema).parquet(f"{x.sf_dir}/events.parque?")  # a pattern may be a file or a folder
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        (F.lit(4000) + k).cast("long").alias("station_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("observed_at"), (F.floor("value").cast("long") % 6).alias("bikes_available"), (F.col("event_id") % 7).alias("docks_available"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("is_renting"), F.when(F.col("user_id") % 50 == 0, 0).otherwise(1).alias("is_returning"), "event_id")


def _run(x, stream, mode: str):
    """Process everything there is into a table in the shared folder and read it back."""
    path = f"{shared_dir(x.spark)}/tidewheel/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").outputMode(mode)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/out").start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
    q.awaitTermination()
    return x.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("st1_st_snapshot_ingest", "SELECT station_id, count(*) AS n FROM v_snapshots GROUP BY station_id")
def _(x):
    s = _stream(x).withColumnsRenamed({"station_id": "feed_id", "observed_at": "timestamp"})
    info = x.stations.select(F.col("station_id").alias("feed_id"), "station_id")
    return _run(x, live.ingest(s, info).select("station_id", "timestamp", "utc_date"), "append").groupBy("station_id").agg(F.count("*").alias("n"))


@query("st2_st_unusable_rate", "SELECT CAST(CAST(observed_at AS DATE) AS VARCHAR) AS day, count(*) AS n_online, count(*) FILTER (unusable) AS n_unusable, count(*) FILTER (unusable) / count(*) AS unusable_rate FROM snaps WHERE is_online GROUP BY ALL")
def _(x):
    r = _run(x, live.unusable_rate(_stream(x)), "complete")
    return r.select(F.to_date("start").cast("string").alias("day"), "n_online", "n_unusable", "unusable_rate")


@query("st3_st_persistence", """SELECT count(*) AS n_with_next, count(*) FILTER (nu) AS n_still FROM (SELECT unusable, observed_at, lead(observed_at) OVER w AS na, lead(unusable) OVER w AS nu FROM snaps WHERE is_online WINDOW w AS (PARTITION BY station_id ORDER BY observed_at, event_id))
    WHERE unusable AND epoch_us(na) - epoch_us(observed_at) <= 4200000000 AND na < (SELECT max(observed_at) - INTERVAL 2 HOUR FROM snaps WHERE is_online)""")
def _(x):
    prepare_workers(x.spark)
    r = _run(x, live.persistence(_stream(x)), "append")
    return r.agg(F.count("*").alias("n_with_next"), F.count_if("still").alias("n_still"))


@query("st4_st_latest_status", "SELECT station_id, bikes_available, docks_available FROM latest")
def _(x):
    path, stream = f"{shared_dir(x.spark)}/tidewheel/latest-{uuid.uuid4().hex}", _stream(x)
    q = stream.writeStream.trigger(availableNow=True).foreachBatch(live.upsert_latest(f"{path}/table")).option("checkpointLocation", f"{path}/state").start()
    q.awaitTermination()
    return live.read_latest(x.spark, f"{path}/table", stream.schema).select("station_id", "bikes_available", "docks_available")
