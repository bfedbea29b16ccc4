"""Pinned semantics of the domain operators on small frames."""
import json
import os
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidewheel import constants as C
from tidewheel.functions import briefs, scalars as S
from tidewheel.operators import availability as A, elasticity, facts, flows, forecast, geo, quality, routing, runs, slices, stats, typology
from tidewheel.sources import facilities, files

TRIP = "ride_id int, started_at timestamp_ntz, ended_at timestamp_ntz, start_station_id string, end_station_id string, start_station_name string, end_station_name string, start_lat double, start_lng double, end_lat double, end_lng double, rideable_type string"
T0 = datetime(2026, 4, 1, 8)


def trip(i, start="1", end="2", at=T0, seconds=900.0, a=(40.0, -74.0), b=(40.1, -74.1), names=None):
    n = names or (start and f"S{start}", end and f"S{end}")
    return (i, at, None if at is None or seconds is None else at + timedelta(seconds=seconds), start, end, *n, *a, *b, "classic_bike")


@pytest.fixture(scope="module")
def trips(spark):
    return lambda rows: spark.createDataFrame(rows, TRIP)


def curve(**at):
    return [float(at.get(f"h{h}", 0.0)) for h in range(24)]


def test_quality_edges(trips):
    rows = [trip(0, seconds=59.6), trip(1, seconds=60.0), trip(2, seconds=14400.0), trip(3, seconds=14400.5), trip(4, seconds=None),
            trip(5, a=(34.03, -118.25)), trip(6, b=(0.0, 0.0)), trip(7, end=None, b=(None, None)), trip(8, start=None)]
    t = trips(rows)
    assert sorted(r.ride_id for r in quality.clean(t).collect()) == [1, 2, 4, 7, 8]  # no duration and no place are kept
    assert tuple(quality.report(t).first()) == (9, 1, 1, 2, 5, 1, 1)


def test_canonical_ids(trips):
    rows = [trip(0, "5980.1", "1"), trip(1, "2", "5980.10"), trip(2, "3593.1", "5308.04_"), trip(3, "5308.04", None), trip(4, "6517.08_", "4")]
    got = {r.ride_id: (r.start_station_id, r.end_station_id) for r in quality.canonicalize(trips(rows), "start_station_id", "end_station_id").collect()}
    assert got == {0: ("5980.10", "1"), 1: ("2", "5980.10"), 2: ("3593.1", "5308.04"), 3: ("5308.04", None), 4: ("6517.08_", "4")}


def test_net_flow_and_throughput(trips):
    rows = [trip(0, end=None), trip(1, "1", None, at=T0 + timedelta(days=1))]
    net = flows.net_flow(trips(rows)).collect()
    assert [(r.station_id, r.net, r.n_days, r.net_per_day) for r in net] == [("1", -2, 2, -1.0)]
    assert [(r["count"], r.throughput_per_day) for r in flows.throughput(trips(rows)).collect()] == [(2, 1.0)]
    assert len(flows.daily_net(trips(rows)).collect()) == 2  # dates stay apart


def test_null_names_form_no_group_and_components_agree(trips):
    rows = [trip(0, names=(None, "S2")), trip(1), trip(2, "2", "1")]
    t = trips(rows)
    assert {r.station_id for r in flows.daily_net(t).collect()} == {"1", "2"}
    comp = {(r.station_id, r.date, r.hour): r for r in flows.daily_components(t).collect()}
    assert {k: r.net for k, r in comp.items()} == {(r.station_id, r.date, r.hour): r.net for r in flows.daily_net(t).collect()}
    assert all(r.lat is not None for r in comp.values())


def test_curves_weight_rounded_values_by_days(spark):
    m = spark.createDataFrame([("a", "2026-01", "weekday", 8, 0.333, 3), ("a", "2026-07", "weekday", 8, 1.0, 1)], "station_id string, month string, day_type string, hour int, net_per_day double, n_days long")
    got = {(r.grain, r.period): r.value for r in flows.curve_points(m).collect()}
    assert got == {("all", "all"): 0.5, ("season", "winter"): 0.333, ("season", "summer"): 1.0, ("month", "2026-01"): 0.333, ("month", "2026-07"): 1.0}
    c = flows.curves(flows.curve_points(m)).filter("grain = 'all'").first().curve
    assert len(c) == 24 and c[8] == 0.5 and sum(c) == 0.5


def test_repair_conserves_trips(spark):
    d = spark.createDataFrame([("5980.1", "A", date(2026, 4, 1), 8, 1.0, 1.0, 1, 2, -1), ("5980.10", "B", date(2026, 4, 1), 8, 2.0, 2.0, 3, 0, 3)],
                              "station_id string, station_name string, date date, hour int, lat double, lng double, arrivals_count long, departures_count long, net long")
    r = flows.repair(d, ["2026-04"]).collect()
    assert [(x.station_id, x.station_name, x.arrivals_count, x.departures_count, x.net, x.lat) for x in r] == [("5980.10", "B", 4, 2, 2, 2.0)]
    assert flows.replace_months(d, d.limit(0), ["2026-04"]).count() == 0


SNAP = "station_id string, observed_at timestamp_ntz, bikes_available int, docks_available int, is_renting int, is_returning int, event_id int"


def test_availability(spark):
    at = lambda m: datetime(2026, 7, 13, 18) + timedelta(minutes=m)
    rows = [("A", at(0), 0, 30, 1, 1, 0), ("A", at(60), 0, 0, 1, 1, 1), ("A", at(180), 5, 5, 1, 1, 2), ("B", at(0), 3, 0, 1, 1, 3), ("C", at(0), 0, 9, 1, 0, 4)]
    s = spark.createDataFrame(rows, SNAP)
    r = A.system(s).first()
    assert (r.n_online, r.n_unusable, r.n_empty, r.n_full, r.n_offline, r.unusable_rate) == (4, 3, 2, 2, 1, 0.75)  # weighted by observations
    assert {x.station_id for x in A.by_station(s).collect()} == {"A", "B"}
    w = A.window(s).first()
    assert (w.median_gap_min, w.max_gap_min, w.longest_gap_start, w.span_days) == (90.0, 120.0, at(60), 1)
    p = A.persistence(s).first()
    assert (p.n_with_next, p.n_still) == (1, 1)
    assert A.summary(s).first().n_rankable == 0


def test_spatial_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(f"p{i}", float(40.5 + rng.random() * 0.4), float(-74.1 + rng.random() * 0.4)) for i in range(60)]
    fac = [(f"f{i}", i, float(40.5 + rng.random() * 0.4), float(-74.1 + rng.random() * 0.4)) for i in range(40)]
    fac += [("twin", 40, fac[0][2], fac[0][3]), ("far", 41, -33.0, 151.0)]
    p, f = spark.createDataFrame(pts, "station_id string, lat double, lng double"), spark.createDataFrame(fac, "name string, ordinal int, lat double, lng double")
    m = lambda a, b: routing._metres({"lat": a[-2], "lng": a[-1]}, {"lat": b[-2], "lng": b[-1]})
    want = {a[0]: min(fac, key=lambda b: (round(m(a, b), 6), b[1]))[0] for a in pts}
    assert {r.station_id: r.nearest for r in geo.nearest(p, f, start_m=500).collect()} == want
    assert geo.nearest(p.limit(1), f.filter("name = 'far'")).first().nearest == "far"
    pairs = {(r.station_id, r.other_station_id) for r in geo.within(p, p, 3000).collect()}
    assert pairs == {(a[0], b[0]) for a in pts for b in pts if m(a, b) <= 3000}


def test_adjacency(spark):
    near = [("A", 40.7, -74.0, True), ("B", 40.7005, -74.0, True), ("C", 40.75, -74.0, False)]
    s = spark.createDataFrame(near, "station_id string, lat double, lng double, unusable boolean")
    r = geo.double_outage(s).first()
    assert (r.n_breach, r.availability_pct) == (2, 33.333)
    assert geo.double_outage(s.withColumn("lat", F.when(F.col("station_id") == "B", 40.75).otherwise(F.col("lat")))).first().availability_pct == 100.0


def test_context_flags_and_records(spark):
    s = spark.createDataFrame([("A", 40.7, -74.0)], "station_id string, lat double, lng double")
    d = 300 / 111194.9266
    f = spark.createDataFrame([("housing", 0, "h", 40.7 + d * 0.9999, -74.0), ("school", 0, "s", 40.7 + d * 1.01, -74.0), ("subway", 0, "u", 40.72, -74.0)], "layer string, ordinal int, name string, lat double, lng double")
    r = geo.context(s, f).first()
    assert (r.near_housing, r.near_school, r.transit_gap) == (1, 0, 1)
    raw = spark.createDataFrame([("a", "Open", "40.1", "-74"), ("b", "Open", "NULL", "-74"), ("c", "Open", "", ""), ("d", "Closed", "1", "1")], "location_name string, status_descriptions string, latitude string, longitude string")
    assert [x.name for x in facilities.open_schools(raw).collect()] == ["a"]
    sq = [[[-74.0, 40.0], [-73.0, 40.0], [-73.0, 41.0], [-74.0, 41.0], [-74.0, 40.0]]]
    hole = [*sq, ]
    shapes = spark.createDataFrame([("x", [hole]), ("y", None)], "name string, geometry array<array<array<array<double>>>>")
    got = facilities.housing(shapes).collect()
    assert len(got) == 1 and got[0].lat == pytest.approx(40.5) and got[0].lng == pytest.approx(-73.5)


def test_zones(spark):
    s = spark.createDataFrame([("a", 40.70, -74.0), ("b", 40.701, -74.0), ("c", 40.85, -74.0)], "station_id string, lat double, lng double")
    z = {r.station_id: r.zone for r in geo.zones(s, 5.0).collect()}
    assert z["a"] == z["b"] == 0 and z["c"] == 1
    assert geo.zones(s.limit(1)).first().zone == 0


def test_regressions(spark):
    rng = np.random.default_rng(1)
    t, p = rng.normal(10, 8, 400), rng.random(400) * 10
    y = 5 + 0.4 * t - 0.2 * p + rng.normal(0, 0.5, 400)
    d = spark.createDataFrame([("k", float(a), float(b), float(c)) for a, b, c in zip(y, t, p)], "key string, y double, t double, p double")
    x = np.column_stack([np.ones(400), t, p])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    cov = ((y - x @ beta) ** 2).sum() / 397 * np.linalg.inv(x.T @ x)
    fit, r = stats.ols(d, "y", ["t", "p"]), stats.regress2(d, "y", "t", "p", "key").first()
    assert fit["beta"] == pytest.approx(beta) and fit["cov"] == pytest.approx(cov)
    assert (r.b0, r.b1, r.b2, r.se1, r.se2) == pytest.approx((*beta, cov[1, 1] ** 0.5, cov[2, 2] ** 0.5))
    assert stats.ols(d.withColumn("t2", F.col("t") * 2), "y", ["t", "t2"]) is None
    assert stats.ols(d.limit(3), "y", ["t", "p"]) is None
    assert stats.regress2(d.withColumn("t2", F.col("t") * 2), "y", "t", "t2", "key").first().b1 is None


def test_spearman_and_wilcoxon(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 7.0), (3, 7.0), (4, 1.0)], "a int, b double")
    ra, rb = np.array([1, 2.5, 2.5, 4, 5]), np.array([2, 3, 4.5, 4.5, 1])
    assert stats.spearman(d, "a", "b").first().rho == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    assert stats.spearman(d.limit(2), "a", "b").first().rho is None
    assert stats.wilcoxon([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [0] * 12) == (0, 2 / 4096)
    assert stats.wilcoxon([1.0, 1.0], [1.0, 1.0]) is None
    signs = [1, 1, -1] + [1] * 9  # the rank-3 difference alone is negative
    assert stats.wilcoxon([s * (i + 1) for i, s in enumerate(signs)], [0] * 12) == (3, pytest.approx(0.00244140625))


def test_gap_points_formula(spark):
    rows = [(20 * i % 60 + 10, float(i % 7 + 1), 0.2 - 0.001 * (20 * i % 60 + 10) + 0.01 * (i % 3)) for i in range(40)]
    r = stats.capacity_reliability(spark.createDataFrame(rows, "capacity int, demand double, unusable_rate double")).first()
    assert r.reliability_gap_points == pytest.approx(-r.rate_per_dock * 2000) and r.headline
    assert [(b.band, b.n) for b in stats.bands(spark.createDataFrame([(50, 0.5)], "capacity int, unusable_rate double")).orderBy("band").collect()] == [("20-39", 0), ("40+", 1), ("<20", 0)]


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(S.hour_label(F.lit(h))) for h in (0, 8, 12, 17)] == ["12 AM", "8 AM", "12 PM", "5 PM"]
    assert get(S.hour_gap(F.lit(23), F.lit(1))) == 2
    assert [get(S.ordinal(F.lit(n))) for n in (1, 11, 22, 2507)] == ["1st", "11th", "22nd", "2,507th"]
    assert [get(S.precip_bin(F.lit(v))) for v in (0.0, 0.1, 5.0, 20.0, 20.1)] == ["dry", "dry", "light", "moderate", "heavy"]
    tier = lambda t: get(S.extrapolation_tier(F.lit(t), F.lit(0.0), F.lit(20.0)))
    assert [tier(t) for t in (0.0, 20.0, 25.0, -5.0, 26.0)] == ["gbm", "gbm", "gam", "gam", "naive"]
    flat = F.array(*[F.lit(0.04)] * 24)
    assert get(S.fill_hour(flat)) is None and get(S.first_max_hour(flat)) == 0
    assert get(S.normalize_name(F.lit("W 59 St & 4-Ave."))) == "w 59 st and 4 ave"
    basis = S.spline_basis(F.lit(3.3), [0.0, 2.0, 4.0, 6.0, 8.0])
    assert get(sum(basis[1:], basis[0])) == pytest.approx(1.0) and len(basis) == 7


def test_ranks_and_verdicts(spark):
    r = spark.createDataFrame([("A", 0.9, 30), ("B", 0.5, 30), ("C", 0.5, 30), ("D", 0.1, 30), ("E", 0.99, 3)], "station_id string, unusable_rate double, n_observations int")
    assert {x.station_id: x["rank"] for x in facts.rank_unusable(r).collect()} == {"A": 1, "B": 2, "C": 2, "D": 4}
    c = spark.createDataFrame([(curve(h8=5, h17=-5), curve(h9=5, h17=-5)), (curve(h8=5, h17=-5), curve(h12=5, h17=-5))], "a array<double>, b array<double>")
    no = F.lit(False)
    assert [x[0] for x in c.select(S.weekend_differs("a", "b", no, no)).collect()] == [False, True]
    assert c.select(S.weekend_differs("a", "b", F.lit(True), no)).first()[0] is None
    names = F.lit("Commuter core (fills AM, drains PM)")
    assert c.select(S.typology_matches(names, "a", no)).first()[0] is True


def test_typology_separates_rhythms(spark):
    rows = [(f"c{i}", curve(h7=3 + i * 0.3, h8=5, h17=-4 - i * i * 0.05, h18=-4)) for i in range(8)] + [(f"r{i}", curve(h7=-3 + i * i * 0.04, h8=-5 - i * 0.3, h17=4, h18=4)) for i in range(8)] + [("low", curve(h3=0.1))]
    shapes = typology.shape_matrix(spark.createDataFrame(rows, "station_id string, curve array<double>"))
    k, model, scores = typology.select_k(shapes, (2, 4), restarts=2)
    assert k == 2 and scores[2] > 0.8
    got = {r.station_id: r.cluster_name for r in typology.assign(shapes, model).collect()}
    assert got["c0"].startswith("Commuter") and got["r0"].startswith("Residential") and got["low"] == "Low signal"
    with pytest.raises(ValueError):
        typology.select_k(shapes.limit(2))


def test_candidates_and_greedy_tour(spark):
    rows = [("a", curve(h6=-1.0)), ("b", curve(h6=0.9)), ("c", curve(h6=2.5)), ("d", curve(h6=1.0))]
    got = {r.station_id: (r.kind, r.magnitude) for r in routing.candidates(spark.createDataFrame(rows, "station_id string, curve array<double>")).collect()}
    assert got == {"a": ("deficit", 1), "c": ("surplus", 2), "d": ("surplus", 1)}
    st = lambda i, kind, m, lat, lng: {"station_id": i, "kind": kind, "magnitude": m, "lat": lat, "lng": lng}
    stops, left = routing.plan([st("s", "surplus", 15, 40.7, -74.0), st("t", "deficit", 15, 40.71, -74.0)], 1)
    assert [s[3:] for s in stops] == [("s", "pickup", 15, 15), ("t", "dropoff", 15, 0)] and not stops[0][1] and set(left.values()) == {0}


def test_fleet_sweep(spark):
    rows = []
    for i in range(10):
        rows += [(f"s{i:02d}", 40.5 + 0.05 * i, -74.0, "surplus", 8), (f"t{i:02d}", 40.5 + 0.05 * i + 0.001, -74.0, "deficit", 8)]
    c = spark.createDataFrame(rows, "station_id string, lat double, lng double, kind string, magnitude int")
    got = routing.marginal(routing.fleet_sweep(c, sizes=(1, 2, 3, 4, 5), capacity=10, max_stops=6)).orderBy("n_trucks").collect()
    served = [r.n_deficit_serviced for r in got]
    assert served == sorted(served) and served[0] == 3 and served[-1] == 10
    assert [r.marginal_serviced for r in got] == [b - a for a, b in zip([0, *served], served)]


def test_baselines_fall_back(spark):
    m = spark.createDataFrame([("a", "weekday", 8, 2.0, 1), ("a", "weekday", 9, 1.0, 3)], "station_id string, day_type string, hour int, net_per_day double, n_days int")
    t = spark.createDataFrame([("a", "weekday", 8), ("a", "weekday", 10), ("z", "weekday", 8)], "station_id string, day_type string, hour int")
    p = {(r.station_id, r.hour): r.predicted for r in forecast.predict(t, forecast.naive(m), forecast.flat(m)).collect()}
    assert p == {("a", 8): 2.0, ("a", 10): 1.25, ("z", 8): 0.0}
    d = spark.createDataFrame([(date(2026, 1, 1) + timedelta(days=i),) for i in range(20)], "date date")
    assert forecast.split_recent(d).filter("is_validation").count() == 3
    assert "2025-11-27" in forecast.us_holidays("2025-09-01", "2026-08-31")


def test_slices(spark):
    pts = spark.createDataFrame([("A", "all", "weekday", 8, 12.0), ("B", "all", "weekday", 8, -9.0), ("C", "all", "weekday", 8, 1.0)], "station_id string, period string, day_type string, hour int, value double")
    r = slices.totals(pts).first()
    assert (r.out_of_place, r.to_move, r.n_stations) == (22.0, 9.0, 3)
    assert {x.bucket: x.n for x in slices.buckets(pts).collect()} == {"big_deficit": 1, "near_balanced": 1, "big_surplus": 1}


def test_sample_takes_turns(spark):
    rows = []
    for i in range(60):
        rows.append((f"s{i:02d}", json.dumps({"typology_matches_peak": [True, False, None][i % 3], "weekday_flow": {"low_signal": i % 7 == 0}, "reliability": {"status": "no_data" if i % 5 == 0 else "ok"}, "weekend_differs": i % 11 == 0})))
    pools = [[i for i, r in rows if test(json.loads(r))] for test in (lambda r: r["typology_matches_peak"] is False, lambda r: r["typology_matches_peak"] is True, lambda r: r["weekday_flow"]["low_signal"], lambda r: r["reliability"]["status"] == "no_data", lambda r: r["weekend_differs"])]
    for n in (3, 20, 200):
        want = []
        while len(want) < n and any(set(p) - set(want) for p in pools):
            for p in pools:
                rest = [i for i in p if i not in want]
                if rest and len(want) < n:
                    want.append(rest[0])
        assert briefs.sample(spark.createDataFrame(rows, "station_id string, record string"), n) == want


def test_runs(spark, tmp_path):
    one = lambda: spark.range(3)

    def fails():
        raise RuntimeError("no feed")

    got = runs.run_all(spark, [("a", one), ("b", one), ("c", fails), ("d", one)], skip=("a",), write=lambda name, f: f.write.parquet(f"{tmp_path}/{name}")).collect()
    assert [(r.name, r.status, r.n_rows) for r in got] == [("a", "skipped", None), ("b", "done", 3), ("c", "failed", None), ("d", "not run", None)]
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3
    with pytest.raises(ValueError):
        runs.run_all(spark, [("a", one)], skip=("z",))


def test_archives_and_logs(spark, tmp_path):
    import zipfile

    head = ",".join(files.TRIP_COLUMNS)
    with zipfile.ZipFile(tmp_path / "202604-x.zip", "w") as z:
        z.writestr("b.csv", f"{head}\nr2,e,2026-04-01 08:00:00,bad,n,5980.10,n,1,40.0,-74.0,,,member\n")
        z.writestr("a.csv", f"{head}\nr1,e,2026-04-01 08:00:00.123,2026-04-01 08:10:00,n,5980.1,n,1,40.0,-74.0,40.1,-74.1,member\n")
        z.writestr("__MACOSX/a.csv", "junk")
    rows = files.read_trip_zip(spark, str(tmp_path / "202604-x.zip")).orderBy("ride_id").collect()
    assert [(r.ride_id, r.start_station_id) for r in rows] == [("r1", "5980.1"), ("r2", "5980.10")] and rows[1].ended_at is None and rows[1].end_lat is None
    assert quality.drifted({"a": ["x", "y"], "b": ["y", "x"], "c": ["x"]}) == ["c"]
    (tmp_path / "log").mkdir()
    line = "station_id,timestamp,bikes_available,docks_available,is_renting,is_returning\nA,2026-07-13 18:00:00+00:00,0,30,1,1\n"
    (tmp_path / "log/snapshots_1.csv").write_text(line)
    (tmp_path / "log/other.csv").write_text(line)
    assert files.read_snapshot_log(spark, str(tmp_path / "log")).count() == 1


def test_feeds_and_paged_source(spark, tmp_path):
    import http.server
    import json
    import threading
    from urllib.parse import parse_qs, urlparse

    (tmp_path / "s.json").write_text(json.dumps({"last_updated": 1700000000, "data": {"stations": [{"station_id": "f1", "num_bikes_available": 0, "num_docks_available": 0, "is_renting": 1, "is_returning": 1}, {"station_id": "f9"}]}}))
    (tmp_path / "i.json").write_text(json.dumps({"data": {"stations": [{"station_id": "f1", "short_name": "A", "capacity": None}]}}))
    live, dropped = A.live_status(*files.read_feed(spark, str(tmp_path / "s.json"), str(tmp_path / "i.json")))
    assert [(r.station_id, r.capacity, r.is_renting) for r in live.collect()] == [("A", 0, True)] and dropped.first().n_dropped == 1

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            if "lat" in q:
                body = {"daily": {"time": ["2026-01-01"], "temperature_2m_mean": [float(q["lat"][0])], "precipitation_sum": [None]}}
            else:
                o, n = int(q["o"][0]), int(q["n"][0])
                body = [{"name": f"r{i}", "geo": [i]} for i in range(o, min(o + n, 25))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    try:
        w = files.read_weather(spark, base + "?lat={lat}&lng={lng}&s={start}&e={end}", [(40.5, -74.0), (41.0, -73.0)], "2026-01-01", "2026-01-01").collect()
        assert sorted((r.zone, r.temp_mean_c, r.precip_mm) for r in w) == [(0, 40.5, None), (1, 41.0, None)]
    finally:
        server.shutdown()


def test_constants_are_whole():
    assert len(C.PRESETS) == 4 and C.MIN_TRIP_S < C.MAX_TRIP_S


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no generated tables here")
@pytest.mark.parametrize("name", ["m10_ml_select_k", "m12_ml_typology"])
def test_registered_k_search_is_the_operators(spark, monkeypatch, name):
    class Called(Exception):
        pass

    def search(shapes, k_range=C.K_RANGE, restarts=C.RESTARTS):
        assert (tuple(k_range), restarts) == ((2, 8), 10)
        raise Called

    monkeypatch.setattr(typology, "select_k", search)
    with pytest.raises(Called):
        contract.queries()[name](spark, "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no generated tables here")
@pytest.mark.parametrize("name, targets", [("m14_ml_gbm", 1), ("m15_ml_recombine_guard", 2)])
def test_registered_trees_are_the_operators(spark, monkeypatch, name, targets):
    assert [(g.max_iter, g.learning_rate, g.max_depth) for g in forecast.GBM_GRID] == [(100, 0.1, None), (200, 0.05, None), (200, 0.1, 6)]
    calls = []

    def gbm_many(train, of, grid=forecast.GBM_GRID):
        assert grid is forecast.GBM_GRID and all(of.values())
        calls.extend((t, {r.month for r in train.select("month").distinct().collect()}) for t in of)
        assert {*forecast.GBM_NUMERIC, *forecast.GBM_CLASSES, *forecast.ROW_KEYS} <= set(train.columns)
        return {t: (lambda df, t=t: df.withColumn("gbm", F.lit(1000.0 if t == "arrivals_count" else 0.0)), grid[0], 0.0) for t in of}

    monkeypatch.setattr(forecast, "gbm_many", gbm_many)
    monkeypatch.setattr(typology, "select_k", lambda shapes, k_range, restarts: (_ for _ in ()).throw(AssertionError) if (k_range, restarts) != (C.K_RANGE, C.RESTARTS) else real(shapes, (2, 2), 1))
    rows = contract.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == targets and all(len(m) > 13 and "1996-01" not in m for _, m in calls)
    if targets == 2:
        assert {r.tier: r.mae > 900 for r in rows}["gbm"] and all(r.n == r.n_routed for r in rows)


real = typology.select_k


def test_fold_scores(spark):
    cols = "typology_cluster string, tier string, month string, net double, arrivals_count double, departures_count double, predicted double, gam double, gbm double, guarded double, " + ", ".join(f"{m}_{c}_count double" for m in ("gam", "gbm") for c in ("arrivals", "departures"))
    r = np.random.default_rng(1)
    rows = [(str(i % 3), ("gbm", "gam", "naive")[i % 2], ("1996-01", "1996-07")[i % 5 == 0], *map(float, r.normal(size=7)), *map(float, r.normal(size=4))) for i in range(40)]
    got = {(x.model, x.grouping, x.value): (x.n, x.mae) for x in forecast.fold_scores(spark.createDataFrame(rows, cols)).collect()}
    errors = {"naive": lambda x: x[3] - x[6], "gam": lambda x: x[3] - x[7], "gbm": lambda x: x[3] - x[8], "guarded": lambda x: x[3] - x[9], "gam_arrivals": lambda x: x[4] - x[10], "gbm_departures": lambda x: x[5] - x[13]}
    for model, e in errors.items():
        for grouping, of in (("overall", lambda x: "all"), ("season", lambda x: "winter" if x[2] == "1996-01" else "summer"), ("typology", lambda x: x[0]), ("tier", lambda x: x[1])):
            for value in {of(x) for x in rows}:
                own = [abs(e(x)) for x in rows if of(x) == value]
                n, mae = got[model, grouping, value]
                assert n == len(own) and mae == pytest.approx(np.mean(own))


def test_elasticities_against_least_squares(spark):
    r, kinds = np.random.default_rng(4), elasticity.NAMED
    roster, panel = [], []
    for i in range(24):
        kind = kinds[i % 2] if i < 20 else kinds[2] if i < 22 else "Low signal"
        roster.append((f"s{i:02d}", kind, 0.0 if i == 3 else float(2 + r.random()), None if i == 5 else 10 + 3 * i, float(5 + 2 * r.random())))
        for d in range(30 if i != 7 else 9):
            panel.append((f"s{i:02d}", date(2026, 1, 1) + timedelta(days=d), float(r.random() + 0.01 * d), float(d % 11), float(d % 4)))
    a = spark.createDataFrame(roster, "station_id string, cluster_name string, magnitude double, capacity long, throughput double")
    b = spark.createDataFrame(panel, "station_id string, date date, magnitude double, temp_mean_c double, precip_mm double")
    types, stations = elasticity.elasticities(a, b)
    types, stations = {x.cluster_name: x for x in types.collect()}, {x.station_id: x for x in stations.collect()}

    def fit(x, y):
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return beta, ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)

    assert "s03" not in stations and not {"s22", "s23"} & set(stations) and set(types) == set(kinds[:3])
    assert stations["s07"].temp_elasticity is None and stations["s07"].n_obs == 9 and stations["s05"].capacity_elasticity is None
    for kind in kinds[:2]:
        own = [x for x in roster if x[1] == kind]
        m = np.mean([x[2] for x in own])
        rows = np.array([p[2:] for p in panel if p[0] in {x[0] for x in own}])
        beta, cov = fit(np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0])
        assert types[kind].temp_elasticity == pytest.approx(beta[1] / m, abs=1e-4) and types[kind].precip_high == pytest.approx((beta[2] + 1.96 * cov[2, 2] ** 0.5) / m, abs=1e-4)
        known = [x for x in own if x[3]]
        c, t = np.array([float(x[3]) for x in known]), np.array([x[4] for x in known])
        beta, cov = fit(np.column_stack([np.ones(len(c)), c, c * c, t]), np.array([x[2] for x in known]))
        at = lambda v: (beta[1] + 2 * beta[2] * v, (cov[1, 1] + 4 * v * v * cov[2, 2] + 4 * v * cov[1, 2]) ** 0.5)  # noqa: B023, E731
        assert types[kind].capacity_elasticity == pytest.approx(at(c.mean())[0] / m, abs=1e-4) and types[kind].n_stations_with_capacity == len(known)
        one = next(x for x in known if x[2] > 0)
        slope, se = at(float(one[3]))
        assert stations[one[0]].capacity_elasticity == pytest.approx(slope / one[2], abs=1e-4) and stations[one[0]].capacity_low == pytest.approx((slope - 1.96 * se) / one[2], abs=1e-4)
    assert types[kinds[2]].capacity_elasticity is None  # two capacities make no curve


def test_silhouette_against_plain_loops(spark):
    r = np.random.default_rng(2)
    v, label = r.normal(size=(25, 4)), [0] * 12 + [1] * 12 + [2]
    d, out = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), []
    for i in range(25):
        by = {c: [d[i, j] for j in range(25) if label[j] == c and j != i] for c in set(label)}
        a = np.mean(by[label[i]]) if by[label[i]] else None
        b = min(np.mean(x) for c, x in by.items() if c != label[i])
        out.append(0.0 if a is None else (b - a) / max(a, b))
    rows = spark.createDataFrame([(c, [float(x) for x in y]) for c, y in zip(label, v)], "label int, shape array<double>")
    assert typology.silhouette(rows) == pytest.approx(np.mean(out))


READINGS = "station_id long, observed_at timestamp, bikes_available long, docks_available long, is_renting int, is_returning int, event_id long"


def _stream_files(spark, tmp_path, batches):
    """A stream of one file a batch, in the order given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        import time

        time.sleep(1.1)  # files are taken by age
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def _reading(station, minute, bikes, event):
    return station, datetime(2026, 7, 13) + timedelta(minutes=minute), bikes, 5, 1, 1, event


def test_persistence_of_readings_out_of_order(spark, tmp_path):
    from tidewheel.streaming import availability as live

    late_first = [[_reading(1, 60, 0, 3), _reading(1, 120, 3, 5), _reading(2, 100, 0, 9)], [_reading(1, 30, 0, 2), _reading(1, 0, 0, 1), _reading(1, 90, 0, 4), _reading(2, 40, 0, 8)], [_reading(3, 1000, 1, 6)], [_reading(3, 2000, 1, 7)]]
    out = live.persistence(_stream_files(spark, tmp_path, late_first))
    q = out.writeStream.trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    q.awaitTermination()
    t0 = datetime(2026, 7, 13)
    got = sorted((r.station_id, int((r.observed_at - t0).total_seconds() // 60), int((r.next_at - t0).total_seconds() // 60), r.still) for r in spark.read.schema(live.PERSISTED).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0, 30, True), (1, 30, 60, True), (1, 60, 90, True), (1, 90, 120, False), (2, 40, 100, True)]


def test_latest_table_of_batches_out_of_order(spark, tmp_path):
    from tidewheel.streaming import availability as live

    stream = _stream_files(spark, tmp_path, [[_reading(1, 60, 7, 3), _reading(2, 5, 1, 1)], [_reading(1, 30, 2, 2), _reading(2, 5, 4, 4)], [_reading(3, 0, 9, 5)]])
    q = stream.writeStream.trigger(availableNow=True).foreachBatch(live.upsert_latest(f"{tmp_path}/table")).option("checkpointLocation", f"{tmp_path}/state").start()
    q.awaitTermination()
    assert {r.station_id: r.bikes_available for r in live.read_latest(spark, f"{tmp_path}/table", stream.schema).collect()} == {1: 7, 2: 4, 3: 9}
    assert live.read_latest(spark, f"{tmp_path}/none", stream.schema).count() == 0
