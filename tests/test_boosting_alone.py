"""Models of few rows are fitted by one task each, to the trees that passes find; the shared steps of a fold run once."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import additive, boosting, forecast


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(3_000).withColumns({"lat": F.col("id") % 5 / 10 + 40, "lng": -F.col("id") % 5 / 10, "hour": F.pmod(F.hash("id"), F.lit(24)), "date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 30).cast("int"))})
    r = r.withColumns({"station_id": F.concat(F.lit("s"), (F.col("id") % 5).cast("string")), "day_of_week": F.date_format("date", "EEEE"), "typology_cluster": (F.col("id") % 3).cast("string"), "hour_sin": F.sin("hour"), "hour_cos": F.cos("hour")})
    r = r.withColumns({"temp_mean_c": F.when(F.col("id") % 17 != 0, F.pmod(F.hash("date"), F.lit(30)) * 1.0), "precip_mm": F.pmod(F.hash(F.col("id") + 1), F.lit(4)) * 1.0, "doy_sin": F.sin(F.dayofyear("date")), "doy_cos": F.cos(F.dayofyear("date")), "holiday": F.when(F.col("id") % 23 != 3, 0.0)})
    y = F.floor((F.col("hour") + F.pmod(F.hash(F.col("id") + 2), F.lit(9))) / 8)
    r = r.withColumns({"bin": F.lit("dry"), "arrivals_count": F.when(F.col("id") % 50 != 7, y), "departures_count": F.floor(y / 2) + F.col("id") % 2})
    return r.withColumn("net", F.col("arrivals_count") - F.col("departures_count")).cache()


def many(max_iter, stop_from):
    return [boosting.Job(t, loss, boosting.Setting(max_iter=max_iter, learning_rate=0.5, max_depth=depth, stop_from=stop_from), recent) for t, loss, depth, recent in ((0, "poisson", None, False), (1, "poisson", 3, False), (2, "squared", None, True))]


@pytest.mark.parametrize("alone, stop_from", [(5_000, 10_000), (2_950, 100)])
def test_same_trees_and_errors_by_one_task_and_by_passes(rows, monkeypatch, alone, stop_from):
    monkeypatch.setattr(boosting, "FEW_ROWS", 700)  # several tasks
    b = boosting.Boost(rows, ["hour", "temp_mean_c"], ["day_of_week", "typology_cluster"], ["arrivals_count", "departures_count", "net"], F.col("date") >= "2020-03-20", F.pmod(F.xxhash64("id"), F.lit(10)) == 0)
    jobs = many(18, stop_from)  # past a written state
    (whole, errors), (ours, other) = b.fit(jobs), b.fit(jobs, alone)
    for one, two in zip(whole, ours):
        assert len(one.trees) == len(two.trees) > 1 and one.start == two.start
        for s, t in zip(one.trees, two.trees):
            assert np.array_equal(s.feature, t.feature) and np.array_equal(s.goes_left, t.goes_left) and np.array_equal(s.left, t.left)
            assert np.allclose(s.value, t.value, rtol=1e-9, atol=1e-12)
    assert errors[0] > 0 and np.allclose(errors, other, rtol=1e-9)


def test_a_grid_takes_no_pass_a_round(rows, monkeypatch):
    passes, summed = [], boosting.Boost._summed
    monkeypatch.setattr(boosting.Boost, "_summed", lambda *a: passes.append(1) or summed(*a))
    grid = (boosting.Setting(max_iter=9, learning_rate=0.2), boosting.Setting(max_iter=7, learning_rate=0.3, max_depth=2))
    found = forecast.gbm_many(rows, {"arrivals_count": True, "departures_count": True}, grid)
    assert len(passes) == 2  # the counts of both fits
    assert all(error > 0 and setting in grid for _, setting, error in found.values())


def test_a_design_is_computed_once_for_all_targets(rows, monkeypatch):
    stored, cut = [], additive.cut
    how = additive.design(rows, "temp_mean_c", "hour", forecast.CLASSES, ["holiday", "doy_sin", "doy_cos"])
    alone = additive.fit(rows, "net", how, False)
    monkeypatch.setattr(additive, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    found = forecast.gam_many(rows, {"departures_count": True, "net": False})
    assert [d.count() for d in stored] == [rows.filter("holiday IS NOT NULL").count()]
    assert found["net"](rows).agg(F.max(F.abs(F.col("gam") - alone.column()))).first()[0] < 1e-9
