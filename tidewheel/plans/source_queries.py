"""Queries through the readers: small feeds are written below the shared folder and read back; runs, windows, report facts."""
from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidewheel import constants as C
from tidewheel.functions import canonical, scalars as S
from tidewheel.operators import availability as A, batch, facts, flows, geo, quality, runs
from tidewheel.operators.ordered import ordered
from tidewheel.plans.registry import query
from tidewheel.session import cut, prepare_workers, shared_dir
from tidewheel.sources import files, landing, versions
from tidewheel.streaming import feed


def _folder(x, name: str) -> str:
    """A fresh folder of the shared one."""
    return f"{files.as_uri(shared_dir(x.spark))}/tidewheel/{name}-{uuid.uuid4().hex}"


def _csv_rows(df):
    """``df`` with its row as a CSV line."""
    return df.withColumn("line", F.to_csv(F.struct(*df.columns)))


def _csv(df, name: str, order: str, head: str = ""):
    """(name, content): all rows as one CSV text with a header, in the order of a column."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "line"))), lambda r: r["line"])
    return _csv_rows(df).agg(F.concat(F.lit(",".join(df.columns) + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("content")).select(F.lit(name).alias("name"), "content")


def _trip_rows(x):
    """One row a station of the city, in trip form: as many as there are stations."""
    at = lambda h: F.concat(F.lit("2024-01-15 "), F.lpad(h.cast("string"), 2, "0"), F.lit(":00:00"))
    k = F.col("station_id") - 4000
    return x.stations.orderBy("station_id").select(
        F.concat(F.lit("R"), k).alias("ride_id"), F.lit("classic_bike").alias("rideable_type"), at(k % 20).alias("started_at"), at(k % 20 + 2).alias("ended_at"), F.col("name").alias("start_station_name"),
        F.concat("station_id", F.lit(".10")).alias("start_station_id"), F.col("name").alias("end_station_name"), F.concat("station_id", F.lit(".1")).alias("end_station_id"),
        F.col("lat").alias("start_lat"), F.col("lng").alias("start_lng"), F.col("lat").alias("end_lat"), F.col("lng").alias("end_lng"), F.lit("member").alias("member_casual"))


@query("s1_src_trip_zip", """SELECT 'R' || (station_id - 4000) AS ride_id, station_id || '.10' AS start_station_id, station_id || '.1' AS end_station_id, CAST(7200 AS DOUBLE) AS seconds, '20240' || (1 + station_id % 4) || '-trips.zip' AS archive FROM stations""")
def _(x):
    """Four archives, each packed by a task of its own: two members, a folder and a file that are none."""
    prepare_workers(x.spark)
    columns = files.TRIP_COLUMNS

    def pack(key, pdf):
        pdf, packed = pdf.sort_values("ride_id"), io.BytesIO()
        half = len(pdf) // 2
        with zipfile.ZipFile(packed, "w") as z:
            for number, part in ((2, pdf[half:]), (1, pdf[:half])):
                z.writestr(f"trips_{number}.csv", part[columns].to_csv(index=False))
            z.writestr("__MACOSX/trips_1.csv", "no trips")
            z.writestr("readme.txt", "no trips")
        return pd.DataFrame({"name": [f"20240{key[0]}-trips.zip"], "content": [packed.getvalue()]})

    rows = _trip_rows(x).select(*[F.col(c).cast("string").alias(c) for c in columns], (1 + F.regexp_extract("ride_id", "[0-9]+", 0).cast("int") % 4).alias("month"))
    folder = landing.write_files(rows.groupBy("month").applyInPandas(pack, "name string, content binary"), _folder(x, "archives"))
    t = files.read_trip_zip(x.spark, f"{folder}/*.zip")
    return quality.tag(t).select("ride_id", "start_station_id", "end_station_id", F.col("duration_s").alias("seconds"), "archive")


@query("s2_src_http_archive", "SELECT station_id, name, CAST(1 AS BIGINT) AS fetches FROM stations")
def _(x):
    there = landing.write_files(_csv(x.stations.select("station_id", "name"), "there.csv", "station_id"), _folder(x, "feeds"))
    to, fetches = _folder(x, "landed"), 0
    for _ in range(2):  # the second call finds the file
        fetches += landing.land(x.spark, [(f"{there}/there.csv", "archive.csv")], to, block=512).filter("fetched").count()
    return x.spark.read.schema("station_id long, name string").csv(f"{to}/archive.csv", header=True).withColumn("fetches", F.lit(fetches).cast("long"))


@query("s3_src_socrata_paged", "SELECT CAST(station_id AS VARCHAR) AS station_id, name FROM stations")
def _(x):
    prepare_workers(x.spark)
    page = 16
    rows = ordered(x.stations.select(F.col("station_id").cast("string").alias("station_id"), "name"), ["station_id"], number="place").withColumn("page", F.floor((F.col("place") - 1) / page) * page)
    pages = rows.groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "station_id", "name"))), lambda r: F.struct(r["station_id"].alias("station_id"), r["name"].alias("name")))).alias("content"))
    count = rows.agg(F.to_json(F.array(F.struct(F.count("*").cast("string").alias("count")))).alias("content")).select(F.lit("count.json").alias("name"), "content")
    folder = landing.write_files(pages.select(F.format_string("page-%d.json", "page").alias("name"), "content").unionByName(count), _folder(x, "pages"))
    return landing.land_paged(x.spark, f"{folder}/page-{{offset}}.json", f"{folder}/count.json", ["station_id", "name"], f"{folder}/table", page)


@query("s4_src_weather_api", "SELECT CAST(zone AS INT) AS zone, date, temp_mean_c, precip_mm FROM weather", days=("date",))
def _(x):
    prepare_workers(x.spark)
    day = F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("day"), "temp_mean_c", "precip_mm")))
    of = lambda c: F.transform("d", lambda r: r[c])
    body = F.struct(F.struct(of("day").alias("time"), of("temp_mean_c").alias("temperature_2m_mean"), of("precip_mm").alias("precipitation_sum")).alias("daily"))
    docs = x.weather.groupBy("zone").agg(day.alias("d")).select(F.format_string("%d-0.json", F.col("zone").cast("int")).alias("name"), F.to_json(body, {"ignoreNullFields": "false"}).alias("content"))
    folder = landing.write_files(docs, _folder(x, "weather"))
    zones = sorted((int(n.split("-")[0]), 0) for n in files.names(x.spark, folder) if n.endswith("-0.json"))
    first, last = x.weather.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    for _ in range(2):  # the second read comes from the cache
        w = files.read_weather(x.spark, f"{folder}/{{lat}}-{{lng}}.json", zones, first, last, f"{folder}/cache")
    return w.select(F.col("zone").cast("int").alias("zone"), "date", "temp_mean_c", "precip_mm")


def _feed_documents(x):
    """(name, content) of a status and an information feed over the latest readings; each is one document, as the feeds are."""
    last, stations = A.latest(x.snapshots), x.stations
    feed = F.concat(F.lit("f"), F.col("station_id").cast("string")).alias("station_id")
    one = F.struct(feed, F.col("bikes_available").alias("num_bikes_available"), F.col("docks_available").alias("num_docks_available"), "is_renting", "is_returning")
    status = last.agg(F.struct(F.lit(1700000000).alias("last_updated"), F.struct(F.collect_list(one).alias("stations")).alias("data")).alias("d"))
    info = stations.agg(F.struct(F.struct(F.collect_list(F.struct(feed, F.col("station_id").cast("string").alias("short_name"), "capacity")).alias("stations")).alias("data")).alias("d"))
    document = lambda df, name: df.select(F.lit(name).alias("name"), F.to_json("d", {"ignoreNullFields": "false"}).alias("content"))
    return document(status, "status.json").unionByName(document(info, "information.json"))


@query("s5_src_gbfs", "SELECT s.station_id, s.capacity, l.bikes_available, l.docks_available, l.is_renting, l.is_returning, '2023-11-14 22:13:20' AS at FROM latest l JOIN stations s USING (station_id)")
def _(x):
    folder = landing.write_files(_feed_documents(x), _folder(x, "feeds"))
    s, i = files.read_feed(x.spark, f"{folder}/status.json", f"{folder}/information.json")
    j = s.join(i, "feed_id")
    return j.select(F.col("station_id").cast("long").alias("station_id"), F.col("capacity").cast("long").alias("capacity"), *[F.col(c).cast("long" if c.endswith("available") else "int").alias(c) for c in ("bikes_available", "docks_available", "is_renting", "is_returning")],
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("s5_feed_stream", "SELECT CAST(station_id AS VARCHAR) AS station_id, count(*) AS n, CAST(sum(bikes_available) AS BIGINT) AS bikes, count(DISTINCT observed_at) AS n_polls FROM v_snapshots GROUP BY station_id")
def _(x):
    """Every snapshot time is a poll: spooled by tasks, read as a stream that is started twice, joined with the information feed."""
    rows = x.snapshots.withColumn("at", F.unix_seconds(F.col("observed_at").cast("timestamp")))
    number = ordered(rows.select("at").distinct(), ["at"], number="poll")
    one = F.struct(F.concat(F.lit("f"), F.col("station_id").cast("string")).alias("station_id"), F.col("bikes_available").alias("num_bikes_available"), F.col("docks_available").alias("num_docks_available"), "is_renting", "is_returning")
    polls = rows.groupBy("at").agg(F.collect_list(one).alias("stations")).join(number, "at")  # a poll is one document, as the feed is
    polls = polls.select("poll", F.format_string("%012d-%d.json", "poll", "at").alias("name"), F.to_json(F.struct(F.col("at").alias("last_updated"), F.struct("stations").alias("data")), {"ignoreNullFields": "false"}).alias("content"))
    polls, folder, half = cut(polls), _folder(x, "feed"), number.count() // 2
    for part in (polls.filter(F.col("poll") <= half), polls.filter(F.col("poll") > half)):
        landing.write_files(part, f"{folder}/spool")
        stream = feed.readings(x.spark, f"{folder}/spool").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
    info = x.stations.select(F.concat(F.lit("f"), F.col("station_id").cast("string")).alias("feed_id"), F.col("station_id").cast("string").alias("station_id"))
    got = feed.crosswalk(x.spark.read.schema(feed.READINGS).parquet(f"{folder}/out"), info)
    return got.groupBy("station_id").agg(F.count("*").alias("n"), F.sum("bikes_available").alias("bikes"), F.countDistinct("timestamp").alias("n_polls"))


@query("s7_src_log_glob", "SELECT CAST(station_id AS VARCHAR) AS station_id, count(*) AS n, CAST(sum(bikes_available) AS BIGINT) AS bikes FROM v_snapshots GROUP BY station_id")
def _(x):
    cols = [F.col(c).cast("int").alias(c) for c in ("bikes_available", "docks_available", "is_renting", "is_returning")]
    rows = x.snapshots.select(F.col("station_id").cast("string").alias("station_id"), F.col("observed_at").cast("timestamp").alias("timestamp"), *cols)
    folder = _folder(x, "logs")
    rows.write.option("header", True).csv(f"{folder}/written")
    files.rename_all(x.spark, f"{folder}/written", f"{folder}/log", lambda i: f"snapshots_{i:05d}.csv")
    files.put(x.spark, f"{folder}/log/other.csv", b"station_id,timestamp\nX,2024-01-01\n")
    return files.read_snapshot_log(x.spark, f"{folder}/log").groupBy("station_id").agg(F.count("*").alias("n"), F.sum("bikes_available").alias("bikes"))


@query("s8_src_json_doc", "SELECT station_id, name, capacity FROM stations")
def _(x):
    each = F.map_from_entries(F.collect_list(F.struct(F.col("station_id").cast("string"), F.struct("name", "capacity"))))
    made = x.stations.agg(F.to_json(F.struct(each.alias("stations"))).alias("content")).select(F.lit("stations.json").alias("name"), "content")  # one document
    folder = landing.write_files(made, _folder(x, "document"))
    d = files.read_document(x.spark, f"{folder}/stations.json", "stations map<string, struct<name: string, capacity: long>>")
    return d.select(F.explode("stations").alias("id", "s")).select(F.col("id").cast("long").alias("station_id"), "s.name", "s.capacity")


@query("s12_snk_delete_raw", "SELECT 'landed' AS file, true AS before, false AS after UNION ALL SELECT 'kept', true, true")
def _(x):
    folder = landing.write_files(x.spark.createDataFrame([("landed.zip", "x"), ("kept.zip", "x")], "name string, content string"), _folder(x, "raw"))
    paths = {name: f"{folder}/{name}.zip" for name in ("landed", "kept")}
    there = lambda: {n: files.exists(x.spark, p) for n, p in paths.items()}
    before = there()
    files.delete_raw([paths["landed"], paths["landed"] + ".gone"], x.spark)
    after = there()
    return x.spark.createDataFrame([(n, before[n], after[n]) for n in paths], "file string, before boolean, after boolean")


_STEPS = ("download", "flows", "typology", "reliability", "context", "elasticities", "checks")


@query("o1_run_all", """SELECT *, CASE WHEN status = 'failed' THEN 'PATH_NOT_FOUND' END AS message FROM (VALUES (1, 'download', 'skipped', NULL), (2, 'flows', 'done', (SELECT count(*) FROM points)), (3, 'typology', 'done', (SELECT count(*) FROM wkday)), (4, 'reliability', 'done', (SELECT count(*) FROM rel)),
    (5, 'context', 'done', (SELECT count(*) FROM stations)), (6, 'elasticities', 'failed', NULL), (7, 'checks', 'not run', NULL)) t(step, name, status, n_rows)""")
def _(x):
    steps = {"download": lambda: x.raw_trips, "flows": lambda: x.points, "typology": lambda: x.weekday, "reliability": lambda: A.by_station(x.snapshots),
             "context": lambda: geo.context(x.stations, x.facilities), "elasticities": lambda: x.spark.read.parquet(f"{shared_dir(x.spark)}/tidewheel/no-such-table"), "checks": lambda: facts.preset_check(x.weather)}
    return runs.run_all(x.spark, [(n, steps[n]) for n in _STEPS], skip=("download",)).withColumn("message", F.regexp_extract("message", "PATH_NOT_FOUND", 0))


@query("o2_manifest", """SELECT array_to_string(list_sort((SELECT list(DISTINCT month) FROM dkeys)), ',') AS months, count(*) AS n_any, count(*) FILTER (n = (SELECT count(DISTINCT month) FROM dkeys)) AS n_full
    FROM (SELECT station_id, count(DISTINCT month) AS n FROM dkeys GROUP BY station_id)""")
def _(x):
    return runs.manifest(x.daily).withColumn("months", F.array_join("months", ","))


@query("o3_roll_window", """SELECT month, count(*) AS n, CAST(sum(net) AS BIGINT) AS net FROM (SELECT month, net FROM dkeys WHERE month <> (SELECT min(month) FROM dkeys)
    UNION ALL SELECT strftime(date + INTERVAL 84 MONTH, '%Y-%m'), net FROM dkeys WHERE month = (SELECT min(month) FROM dkeys)) GROUP BY month""")
def _(x):
    path = f"{shared_dir(x.spark)}/tidewheel/window-{uuid.uuid4().hex}"
    versions.change(x.spark, path, x.daily)
    first = x.daily.agg(F.min(S.month_key("date"))).first()[0]
    new = x.daily.filter(S.month_key("date") == first).withColumn("date", F.add_months("date", 84))
    runs.roll_window(x.spark, path, new)
    versions.vacuum(x.spark, path, 1)
    return versions.read(x.spark, path).groupBy("month").agg(F.count("*").alias("n"), F.sum("net").alias("net"))


@query("o7_resumable_batch", """SELECT CAST(c_custkey AS VARCHAR) AS station_id, CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_acctbal < 0 THEN c_name || ' owes' ELSE c_name || ' owes nothing' END AS text,
    CASE WHEN c_custkey % 7 = 0 THEN 'template' ELSE 'first' END AS source, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS BIGINT) AS batch FROM customer WHERE c_custkey % 10 <> 0""")
def _(x):
    """A text for every customer: the first batch stops half-way and is taken up again, the second one sends those who owe by then; some have no answer but the plain one, some are gone."""
    path, customers = _folder(x, "batch"), x.table("customer", "c_custkey", "c_name", "c_acctbal")

    def records(owes):
        r = customers.select(F.col("c_custkey").cast("string").alias("station_id"), F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), owes.alias("owes")).alias("record"))
        return r.withColumn("facts_hash", canonical.record_hash(r, ["record"]))

    answer = lambda r: r.filter("record.key % 7 <> 0").select("part", "custom_id", F.concat("record.name", F.when(F.col("record.owes"), " owes").otherwise(" owes nothing")).alias("text"), F.lit("first").alias("source"))
    plain = lambda r: r.select("part", "custom_id", F.col("record.name").alias("text"), F.lit("template").alias("source"))
    before = records(F.lit(False))
    batch.plan(x.spark, path, before)
    batch.work(x.spark, path, lambda r: answer(r).filter("part % 2 = 0"))
    batch.run(x.spark, path, before, [answer, plain])
    later = records(F.col("c_acctbal") < 0).filter("record.key % 10 <> 0")
    return batch.run(x.spark, path, later, [answer, plain]).select("station_id", "text", "source", "batch")


@query("o8_report_facts", """SELECT * FROM (VALUES
    ('trip_first_month', (SELECT min(month) FROM dkeys)), ('trip_last_month', (SELECT max(month) FROM dkeys)), ('trip_n_months', (SELECT CAST(count(DISTINCT month) AS VARCHAR) FROM dkeys)), ('n_stations', (SELECT CAST(count(DISTINCT station_id) AS VARCHAR) FROM dkeys)),
    ('n_stations_full', (SELECT CAST(count(*) AS VARCHAR) FROM (SELECT station_id FROM dkeys GROUP BY station_id HAVING count(DISTINCT month) = (SELECT count(DISTINCT month) FROM dkeys)))),
    ('housing_records', (SELECT CAST(count(*) AS VARCHAR) FROM v_facilities WHERE layer = 'housing')), ('school_records', (SELECT CAST(count(*) AS VARCHAR) FROM v_facilities WHERE layer = 'school')), ('subway_records', (SELECT CAST(count(*) AS VARCHAR) FROM v_facilities WHERE layer = 'subway')),
    ('n_near_housing', (SELECT CAST(count(*) FILTER (dist_m <= 300) AS VARCHAR) FROM near WHERE layer = 'housing')), ('n_near_school', (SELECT CAST(count(*) FILTER (dist_m <= 300) AS VARCHAR) FROM near WHERE layer = 'school')),
    ('n_transit_gap', (SELECT CAST(count(*) FILTER (dist_m >= 800) AS VARCHAR) FROM near WHERE layer = 'subway')), ('housing_threshold_m', '300'), ('school_threshold_m', '300'), ('subway_threshold_m', '800')) t(fact, value)""")
def _(x):
    return facts.report_facts(runs.manifest(x.daily), x.facilities, geo.context(x.stations, x.facilities))
