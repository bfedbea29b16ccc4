"""Ranks, labels, facts records, ground-truth checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.functions import canonical, scalars as S
from tidewheel.operators.ordered import ordered


def rank_unusable(stations: DataFrame, floor: int = C.RANKABLE) -> DataFrame:
    """Competition rank of the unusable rate, 1 = worst, among stations with enough observations.

    Ranks come from counts per distinct rate, added up over ranges of rates.
    """
    rows = stations.filter(F.col("n_observations") >= floor)
    n = rows.groupBy("unusable_rate").agg(F.count("*").alias("_n"))
    ranks = ordered(n, [F.desc("unusable_rate")], sums={"_upto": "_n"}).select("unusable_rate", (F.col("_upto") - F.col("_n") + 1).cast("int").alias("rank"))
    return rows.join(ranks, "unusable_rate").select("station_id", "unusable_rate", "rank")


def window_label(first, last) -> Column:
    """'Sep 2025 – Aug 2026' from two dates."""
    return F.concat(F.date_format(S.col(first), "MMM yyyy"), F.lit(" – "), F.date_format(S.col(last), "MMM yyyy"))


def day_window_label(first, last) -> Column:
    """'Jul 13 – Oct 27, 2026', the year once if shared."""
    a, b = S.col(first), S.col(last)
    one = F.concat(F.date_format(a, "MMM d"), F.lit(" – "), F.date_format(b, "MMM d, yyyy"))
    return F.when(F.year(a) == F.year(b), one).otherwise(F.concat(F.date_format(a, "MMM d, yyyy"), F.lit(" – "), F.date_format(b, "MMM d, yyyy")))


def flow_struct(curve, low) -> Column:
    """fill/drain peak labels and sizes; all null with a low signal."""
    f, d = S.fill_hour(curve), S.drain_hour(curve)
    keep = lambda c: F.when(~S.col(low), c)
    return F.struct(
        keep(F.when(d.isNotNull(), F.bround(-F.array_min(S.col(curve)), 1))).alias("drain_bikes_per_day"), keep(S.hour_label(d)).alias("drain_peak_hour"),
        keep(F.when(f.isNotNull(), F.bround(F.array_max(S.col(curve)), 1))).alias("fill_bikes_per_day"), keep(S.hour_label(f)).alias("fill_peak_hour"), S.col(low).alias("low_signal"))


def station_facts(stations: DataFrame, reliability: DataFrame, context: DataFrame, system_rate: Column, excluded: DataFrame | None = None) -> DataFrame:
    """One wide record per station: flows, weekend and typology verdicts, reliability status and rank, context.

    ``stations``: station_id, name, weekday, weekend (arrays), cluster, cluster_name.
    """
    if excluded is not None:
        stations = stations.join(excluded.select("station_id"), "station_id", "left_anti")
    s = stations.withColumns({"weekday_low": F.col("cluster") == -1, "weekend_low": S.l2_norm("weekend") < C.LOW_VOLUME})
    ranks = rank_unusable(reliability).select("station_id", "rank")
    s = s.join(reliability.select("station_id", "n_observations", "unusable_rate"), "station_id", "left").join(ranks, "station_id", "left").join(context, "station_id", "left")
    n = ranks.agg(F.count("*").alias("n_ranked"))
    s = s.join(n)  # one row
    status = F.when(F.col("n_observations").isNull(), "no_data").when(F.col("rank").isNull(), "not_rankable").otherwise("ok")
    ok = lambda c: F.when(status == "ok", c)
    return s.select(
        "station_id", "name", F.col("cluster_name").alias("typology"), S.typology_matches("cluster_name", "weekday", "weekday_low").alias("typology_matches_peak"),
        flow_struct("weekday", "weekday_low").alias("weekday_flow"), flow_struct("weekend", "weekend_low").alias("weekend_flow"),
        S.weekend_differs("weekday", "weekend", "weekday_low", "weekend_low").alias("weekend_differs"), status.alias("status"),
        ok(F.bround(F.col("unusable_rate") * 100, 1)).alias("unusable_pct"), ok(F.col("rank")).alias("rank"), ok(F.col("n_ranked")).alias("n_ranked"),
        ok(F.bround(system_rate * 100, 1)).alias("system_unusable_pct"), *[c for c in context.columns if c != "station_id"])


def facts_hash(facts: DataFrame, columns: list[str]) -> DataFrame:
    """(station_id, facts_hash): SHA-256 of each record as compact JSON with keys sorted at every level and nulls kept."""
    return facts.select("station_id", canonical.record_hash(facts, columns).alias("facts_hash"))


def changed_only(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``facts`` (station_id, facts_hash) that are new or differ from what is stored."""
    old = stored.select("station_id", F.col("facts_hash").alias("_old"))
    return facts.join(old, "station_id", "left").filter(~F.col("facts_hash").eqNullSafe(F.col("_old"))).drop("_old")


def direction_checks(curves: DataFrame, expected: DataFrame) -> DataFrame:
    """name, passed, detail of stations expected to fill or drain in the morning (curves: weekday arrays)."""
    e = expected.join(curves, "station_id", "left")
    am, pm = S.hour_sum("curve", C.CHECK_AM_HOURS), S.hour_sum("curve", C.CHECK_PM_HOURS)
    fills = F.col("expect") == "fills_am_drains_pm"
    passed = F.when(fills, (am > 0) & (pm < 0)).otherwise((am < 0) & (pm > 0))
    detail = F.when(F.col("curve").isNull(), "station not found").otherwise(F.format_string("AM net=%+.3f, PM net=%+.3f", am, pm))
    return e.select(F.concat(F.lit("station direction: "), "station_id").alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))


def holiday_check(daily: DataFrame, holiday: str, others: list[str], least: float = C.HOLIDAY_DIP) -> DataFrame:
    """Departures on a holiday against the mean of comparison dates; a missing date fails."""
    t = daily.filter(F.col("date").isin([holiday, *others])).groupBy("date").agg(F.sum("departures_count").alias("n"))
    on = F.max(F.when(F.col("date") == holiday, F.col("n")))
    other = F.sum(F.when(F.col("date") != holiday, F.col("n")))
    dip = 1 - on / (other / len(others))
    whole = F.count("*") == len(others) + 1
    return t.agg(F.lit(f"holiday dip: {holiday}").alias("name"), F.coalesce(whole & (dip >= least), F.lit(False)).alias("passed"), F.bround(dip, 6).alias("value"))


def season_check(curves: DataFrame, station: str, least: float = C.SEASON_RATIO) -> DataFrame:
    """Mean absolute weekday flow in summer over winter at a station."""
    rows = curves.filter((F.col("station_id") == station) & (F.col("grain") == "season") & (F.col("day_type") == "weekday"))
    amp = lambda p: F.max(F.when(F.col("period") == p, S.mean_abs("curve")))
    ratio = amp("summer") / F.nullif(amp("winter"), F.lit(0.0))
    passed = F.when(amp("summer").isNotNull() & (amp("winter") == 0), True).otherwise(F.coalesce(ratio >= least, F.lit(False)))
    return rows.agg(F.lit(f"seasonal amplitude: {station}").alias("name"), passed.alias("passed"), F.bround(ratio, 6).alias("value"))


def preset_check(weather: DataFrame) -> DataFrame:
    """Whether every preset temperature lies in the observed range."""
    low, high = min(t for _, t, _ in C.PRESETS), max(t for _, t, _ in C.PRESETS)
    lo, hi = F.min("temp_mean_c"), F.max("temp_mean_c")
    return weather.agg(F.lit("preset temps in observed range").alias("name"), F.coalesce((lo <= low) & (hi >= high), F.lit(False)).alias("passed"), F.bround(hi - lo, 6).alias("value"))


def report_facts(manifest: DataFrame, facilities: DataFrame, context: DataFrame) -> DataFrame:
    """(fact, value) as text: the trips' window and stations, the layers' sizes and thresholds, the stations they flag."""
    layer = lambda name: F.count_if(F.col("layer") == name).alias(f"{name}_records")
    layers = facilities.agg(*[layer(n) for n in ("housing", "school", "subway")])
    flags = context.agg(F.sum("near_housing").alias("n_near_housing"), F.sum("near_school").alias("n_near_school"), F.sum("transit_gap").alias("n_transit_gap"))
    one = manifest.select(F.array_min("months").alias("trip_first_month"), F.array_max("months").alias("trip_last_month"), F.size("months").alias("trip_n_months"), F.col("n_any").alias("n_stations"), F.col("n_full").alias("n_stations_full"))
    one = one.join(layers).join(flags)  # one row each
    one = one.withColumns({"housing_threshold_m": F.lit(C.NEAR_HOUSING_M), "school_threshold_m": F.lit(C.NEAR_SCHOOL_M), "subway_threshold_m": F.lit(C.TRANSIT_GAP_M)})
    text = one.select(*[F.col(c).cast("string").alias(c) for c in one.columns])
    return text.unpivot([], one.columns, "fact", "value")
