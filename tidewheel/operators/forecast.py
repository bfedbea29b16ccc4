"""Features, baselines, model tiers and leave-one-month-out evaluation."""
from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.functions import scalars as S
from tidewheel.operators import additive, boosting
from tidewheel.operators.ordered import ordered
from tidewheel.session import at_once, cut

KEYS = ["station_id", "day_type", "hour"]


def us_holidays(start: str, end: str) -> list[str]:
    """Observed US federal holidays as ISO dates."""
    from pandas.tseries.holiday import USFederalHolidayCalendar

    return [d.strftime("%Y-%m-%d") for d in USFederalHolidayCalendar().holidays(start, end)]


def calendar(df: DataFrame, holidays: list[str]) -> DataFrame:
    doy, hour = F.dayofyear("date") * (2 * pi / 365.25), F.col("hour") * (2 * pi / 24)
    return df.withColumns({
        "month": S.month_key("date"), "day_type": S.day_type("date"), "day_of_week": F.date_format("date", "EEEE"),
        "is_holiday": F.date_format("date", "yyyy-MM-dd").isin(holidays) if holidays else F.lit(False),
        "doy_sin": F.sin(doy), "doy_cos": F.cos(doy), "hour_sin": F.sin(hour), "hour_cos": F.cos(hour)})


def with_weather(daily: DataFrame, station_zone: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of each row's zone and date; rows without one are dropped."""
    return daily.join(station_zone.select("station_id", "zone"), "station_id").join(weather, ["zone", "date"])


def naive(train: DataFrame) -> DataFrame:
    """Mean flow by (station, day type, hour), weighted by each month's days; rows are monthly (net_per_day, n_days)."""
    w = F.sum(F.col("net_per_day") * F.col("n_days")) / F.sum("n_days")
    return train.groupBy(*KEYS).agg(w.alias("predicted"))


def flat(train: DataFrame) -> DataFrame:
    return train.groupBy("station_id").agg((F.sum(F.col("net_per_day") * F.col("n_days")) / F.sum("n_days")).alias("predicted_flat"))


def predict(test: DataFrame, naive_table: DataFrame, flat_table: DataFrame) -> DataFrame:
    """The naive value, else the station's flat one, else 0."""
    out = test.join(naive_table, KEYS, "left").join(flat_table, "station_id", "left")
    return out.withColumn("predicted", F.coalesce("predicted", "predicted_flat", F.lit(0.0))).drop("predicted_flat")


def mae(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("net") - F.col("predicted"))).alias("mae"))


def fold_maes(monthly: DataFrame, daily: DataFrame, months: list[str], by_hour: bool = True) -> DataFrame:
    """Naive-tier MAE of each month predicted from all other months, later ones too; by the station's mean alone unless ``by_hour``.

    All folds are one plan: a fold's sums are the station's totals less its own month's, so no
    month is read once per fold.
    """
    rows = monthly.filter(F.col("month").isin(months)).withColumn("w", F.col("net_per_day") * F.col("n_days"))
    folds = rows.select(F.col("month").alias("fold")).distinct()

    def less_own(keys: list[str], out: str) -> DataFrame:
        total = rows.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("n_days").alias("d"))
        own = rows.groupBy(*keys, F.col("month").alias("fold")).agg(F.sum("w").alias("ow"), F.sum("n_days").alias("od"))
        rest = total.join(F.broadcast(folds)).join(own, [*keys, "fold"], "left")  # a fold per month
        rest = rest.withColumns({"w": F.col("w") - F.coalesce("ow", F.lit(0.0)), "d": F.col("d") - F.coalesce("od", F.lit(0))})
        return rest.filter("d > 0").select(*keys, "fold", (F.col("w") / F.col("d")).alias(out))

    test = daily.withColumns({"fold": S.month_key("date"), "day_type": S.day_type("date")}).filter(F.col("fold").isin(months))
    p = test.join(less_own(KEYS, "predicted"), [*KEYS, "fold"], "left") if by_hour else test.withColumn("predicted", F.lit(None).cast("double"))
    p = p.join(less_own(["station_id"], "predicted_flat"), ["station_id", "fold"], "left")
    return mae(p.withColumn("predicted", F.coalesce("predicted", "predicted_flat", F.lit(0.0))), "fold")


def split_recent(df: DataFrame, fraction: float = C.VALIDATION_FRACTION) -> DataFrame:
    """``df`` with ``is_validation``: the most recent dates, from index floor(n * (1 - fraction))."""
    dates = df.select("date").distinct()
    dates = ordered(dates, ["date"], number="place")
    n = dates.count()
    return df.join(dates.select("date", (F.col("place") - 1 >= F.floor(F.lit(n) * (1 - F.lit(fraction)))).alias("is_validation")), "date")


CLASSES = ["day_of_week", "bin", "typology_cluster"]


def featured(daily: DataFrame, station_zone: DataFrame, weather: DataFrame, holidays: list[str], labels: DataFrame) -> DataFrame:
    """Daily rows with weather, calendar and the cluster of ``labels`` (station_id, cluster); a station without one is unseen."""
    from tidewheel.operators import typology

    rows = typology.with_typology(calendar(with_weather(daily, station_zone, weather), holidays), labels)
    return rows.withColumns({"typology_cluster": F.col("cluster").cast("string"), "holiday": F.col("is_holiday").cast("double"), "bin": F.coalesce(S.precip_bin("precip_mm"), F.lit("nan"))}).drop("cluster")


def fold_frame(daily: DataFrame, station_zone: DataFrame, weather: DataFrame, holidays: list[str], labels: DataFrame) -> DataFrame:
    """:func:`featured` of a stored daily table, stored in parts that keep every core busy (as few as its bytes ask for would be one for a million rows)."""
    tasks = boosting.tasks_of(daily.sparkSession, daily.count())
    return cut(featured(daily, station_zone, weather, holidays, labels).repartition(tasks, *ROW_KEYS))


def gam_many(train: DataFrame, targets: dict[str, bool], alpha: float = 1.0) -> dict:
    """For each target (True: counts) a function that scores a frame, see :func:`gam`; the design is computed once for all."""
    how = additive.design(train, "temp_mean_c", "hour", CLASSES, ["holiday", "doy_sin", "doy_cos"])
    rows = additive.matrix(train, list(targets), how)
    models = at_once([lambda i=i, c=c: additive.fit_rows(rows, f"y{i}", how, c, alpha) for i, c in enumerate(targets.values())])
    return {t: (lambda df, m=m: df.withColumn("gam", m.column())) for t, m in zip(targets, models)}


def gam(train: DataFrame, target: str, counts: bool, alpha: float = 1.0):
    """A spline and one-hot model: Poisson with log link for counts, ridge for net; returns a function that scores a frame.

    Temperature has 5 even knots between the training extremes and is constant beyond them, hour 6 periodic ones; day of
    week, typology cluster and rain class are one-hot, the holiday and the day of the year pass through.  A class not seen in training adds nothing.
    """
    return gam_many(train, {target: counts}, alpha)[target]


GBM_GRID = (boosting.Setting(max_iter=100, learning_rate=0.1), boosting.Setting(max_iter=200, learning_rate=0.05), boosting.Setting(max_iter=200, learning_rate=0.1, max_depth=6))
GBM_NUMERIC = ["lat", "lng", "hour_sin", "hour_cos", "temp_mean_c", "precip_mm", "doy_sin", "doy_cos", "holiday"]
GBM_CLASSES = ["day_of_week", "typology_cluster"]
ROW_KEYS = ["station_id", "date", "hour"]


def gbm_many(train: DataFrame, targets: dict[str, bool], grid=GBM_GRID) -> dict[str, tuple]:
    """For each target (True: counts, with Poisson loss; else squared loss): (function that scores a frame, setting, its error).

    The setting of the least mean absolute error on the recent dates wins and is refitted on all; all settings and
    targets grow in the same passes over the rows.  Rows put aside to stop early are a tenth by a hash of their key.
    """
    names = list(targets)
    split = cut(split_recent(train.select(*dict.fromkeys([*ROW_KEYS, *GBM_NUMERIC, *GBM_CLASSES, *names]))))  # read once for each feature's bins, and for the blocks
    aside = F.pmod(F.xxhash64(*ROW_KEYS), F.lit(10)) == 0
    rows = boosting.Boost(split, GBM_NUMERIC, GBM_CLASSES, names, F.col("is_validation"), aside)
    loss = {t: "poisson" if counts else "squared" for t, counts in targets.items()}
    jobs = [boosting.Job(i, loss[t], s, False) for i, t in enumerate(names) for s in grid]
    _, errors = rows.fit(jobs, boosting.ALONE)
    best = []
    for i in range(len(names)):
        own = errors[i * len(grid) : (i + 1) * len(grid)]
        best.append(min(range(len(grid)), key=lambda k: (own[k] if own[k] is not None else float("inf"), k)))
    models, _ = rows.fit([boosting.Job(i, loss[t], grid[k], True) for i, (t, k) in enumerate(zip(names, best))], boosting.ALONE)
    return {t: (lambda df, m=m: m.transform(df, "gbm"), grid[k], errors[i * len(grid) + k]) for i, (t, m, k) in enumerate(zip(names, models, best))}


def gbm(train: DataFrame, target: str, grid=GBM_GRID, counts: bool = True):
    """Boosted trees of one target; a function that scores a frame.  See :func:`gbm_many`."""
    return gbm_many(train, {target: counts}, grid)[target][0]


def run_fold(rows: DataFrame, month: str, station_zone: DataFrame, weather: DataFrame, holidays: list[str], grid=GBM_GRID, scale: float = 1.0) -> DataFrame:
    """The rows of ``month`` with every tier's prediction of net, all models fitted on the other months.

    Typology is refitted on the training months; arrivals and departures have models of their own, and net is their
    difference; ``tier`` is what the training range of temperatures allows and ``guarded`` that tier's value.
    """
    from tidewheel.operators import flows, typology

    rows = cut(rows)  # read by the typology, the features and the naive tier
    held = S.month_key("date") == month
    labels = cut(typology.refit(rows.filter(~held), scale))
    frame = fold_frame(rows, station_zone, weather, holidays, labels)
    train, test = frame.filter(f"month <> '{month}'"), frame.filter(f"month = '{month}'")
    targets = dict.fromkeys(("arrivals_count", "departures_count"), True)
    monthly, smooth, trees = at_once([lambda: cut(flows.monthly_from_daily(rows.filter(~held))), lambda: gam_many(train, targets), lambda: gbm_many(train, targets, grid)])
    out = predict(test, naive(monthly), flat(monthly))
    for t in targets:
        out = trees[t][0](smooth[t](out).withColumnRenamed("gam", f"gam_{t}")).withColumnRenamed("gbm", f"gbm_{t}")
    out = out.withColumns({t: F.col(f"{t}_arrivals_count") - F.col(f"{t}_departures_count") for t in ("gam", "gbm")})
    low, high = train.agg(F.min("temp_mean_c"), F.max("temp_mean_c")).first()
    return guarded(out, F.lit(low), F.lit(high))


def fold_scores(p: DataFrame) -> DataFrame:
    """(model, grouping, value, n, mae) of a fold's predictions: overall, by season, by cluster and by tier, for net and the two counts."""
    tiers = {"naive": ("net", "predicted"), "gam": ("net", "gam"), "gbm": ("net", "gbm"), "guarded": ("net", "guarded")}
    tiers |= {f"{t}_{c}": (f"{c}_count", f"{t}_{c}_count") for t in ("gam", "gbm") for c in ("arrivals", "departures")}
    errors = F.array(*[F.struct(F.lit(k).alias("model"), F.abs(F.col(y) - F.col(v)).alias("e")) for k, (y, v) in tiers.items()])
    each = p.select(F.col("typology_cluster").alias("typology"), "tier", S.season("month").alias("season"), F.explode(errors).alias("m")).select("typology", "tier", "season", "m.model", "m.e")
    model = F.col("model")
    sets = each.groupingSets([[model], [model, F.col("season")], [model, F.col("typology")], [model, F.col("tier")]], "model", "season", "typology", "tier").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
    kinds = ("season", "typology", "tier")
    grouping = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds], F.lit("overall"))
    return sets.select("model", grouping.alias("grouping"), F.coalesce(*kinds, F.lit("all")).alias("value"), "n", "mae")


def guarded(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Route each row by how far its temperature lies outside the training range."""
    tier = S.extrapolation_tier("temp_mean_c", low, high)
    return df.withColumn("tier", tier).withColumn("guarded", F.when(F.col("tier") == "gbm", F.col("gbm")).when(F.col("tier") == "gam", F.col("gam")).otherwise(F.col("predicted")))
