"""Shape clustering of weekday curves: normalised vectors, k by silhouette, named clusters."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.functions import scalars as S
from tidewheel.operators import flows
from tidewheel.session import at_once, cut

LOW_SIGNAL = -1
UNSEEN = -2
BLOCK = 1024  # stations of a block: two blocks and their distances are what a task holds


def shape_matrix(curves: DataFrame, threshold: float = C.LOW_VOLUME) -> DataFrame:
    """station_id, strength, is_low, shape (curve / L2 norm; null below the threshold)."""
    n = S.l2_norm("curve")
    return curves.select("station_id", "curve", n.alias("strength"), (n < threshold).alias("is_low"), F.when(n >= threshold, S.l2_normalize("curve")).alias("shape"))


def silhouette(df: DataFrame, label: str = "label", vector: str = "shape") -> float | None:
    """Mean Euclidean silhouette.

    Every vector is compared with every other, which the measure asks for: blocks of ``BLOCK`` rows meet in pairs, a pair a row,
    and each answers with its rows' summed distances to the clusters of the other.  So the work grows with the square
    of the rows, and a task's memory does not; the driver sees cluster sizes.
    """
    rows = df.select(F.col(label).cast("long").alias("l"), F.col(vector).alias("v"))
    size = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each cluster
    if not size:
        return None
    labels, sizes = np.array(sorted(size)), np.array([size[c] for c in sorted(size)])

    def pack(frames):
        for pdf in frames:
            for start in range(0, len(pdf), BLOCK):
                part = pdf.iloc[start : start + BLOCK]
                yield pd.DataFrame({"l": [part["l"].to_numpy(np.int64).tobytes()], "v": [np.array(part["v"].tolist(), float).tobytes()]})

    def opened(l: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(labels, np.frombuffer(l, np.int64))
        return at, np.frombuffer(v, float).reshape(len(at), -1)

    def distances(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                (own, x), (at, y) = opened(r.l, r.v), opened(r.l2, r.v2)
                total = np.zeros((len(own), len(labels)))
                for start in range(0, len(own), 64):
                    far = np.sqrt(((x[start : start + 64, None] - y[None]) ** 2).sum(axis=2))
                    for c in np.unique(at):
                        total[start : start + 64, c] = far[:, at == c].sum(axis=1)
                yield pd.DataFrame({"b": [r.b], "l": [r.l], "b2": [r.b2], "total": [total.tobytes()]})

    def score(pdf):  # a block's sums from every other block
        own = np.searchsorted(labels, np.frombuffer(pdf["l"].iloc[0], np.int64))
        total = sum(np.frombuffer(t, float).reshape(len(own), -1) for t in pdf.sort_values("b2")["total"])
        i, alone = np.arange(len(own)), sizes[own] == 1
        a = total[i, own] / np.where(alone, 1, sizes[own] - 1)
        mean = total / sizes
        mean[i, own] = np.inf
        b, s = mean.min(axis=1), np.zeros(len(own))
        some = ~alone & np.isfinite(b) & (np.maximum(a, b) > 0)
        s[some] = ((b - a) / np.maximum(a, b))[some]
        return pd.DataFrame({"s": s})

    blocks = cut(rows.mapInPandas(pack, "l binary, v binary").withColumn("b", F.monotonically_increasing_id()))
    tasks = -(-(blocks.count() ** 2) // 32)  # some 32 pairs in a task
    pairs = blocks.crossJoin(blocks.select(F.col("b").alias("b2"), F.col("l").alias("l2"), F.col("v").alias("v2"))).repartition(tasks, "b", "b2")
    totals = pairs.mapInPandas(distances, "b long, l binary, b2 long, total binary")
    return totals.groupBy("b").applyInPandas(score, "s double").agg(F.avg("s")).first()[0]


def select_k(shapes: DataFrame, k_range=C.K_RANGE, restarts: int = C.RESTARTS):
    """(k, fitted model, scores): the first k of best silhouette; per k the restart of least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cut(shapes.filter("shape IS NOT NULL").withColumn("features", array_to_vector("shape")))  # the curves are computed once, for counting, fits and scores
    n, scores, models = rows.count(), {}, {}
    rows = rows.orderBy("station_id").coalesce(max(1, n // 4096)).persist()  # a fit is many passes over few rows; it starts from rows drawn by their place, so places are fixed
    rows.count()  # held before fits ask for it side by side
    ks = [k for k in range(k_range[0], k_range[1] + 1) if k < n]
    fit = lambda k, s: lambda: KMeans(k=k, seed=C.SEED + s, featuresCol="features", predictionCol="label", maxIter=50, initMode="random").fit(rows)
    fits = at_once([fit(k, s) for k in ks for s in range(restarts)])
    for i, k in enumerate(ks):
        models[k] = min(fits[i * restarts : (i + 1) * restarts], key=lambda m: m.summary.trainingCost)
    scores = dict(zip(ks, at_once([lambda m=models[k]: silhouette(m.transform(rows)) for k in ks])))
    rows.unpersist()
    if not scores:
        raise ValueError(f"not enough stations ({n}) for any k")
    best = max(scores, key=lambda k: (scores[k], -k))
    return best, models[best], scores


def name_cluster(center) -> Column:
    """A name from AM and PM means of a 24-value centre."""
    c = S.col(center)
    am, pm = S.hour_sum(c, C.AM_HOURS) / len(C.AM_HOURS), S.hour_sum(c, C.PM_HOURS) / len(C.PM_HOURS)
    spread = F.array_max(c) - F.array_min(c)
    diff, margin = pm - am, spread * C.NAMING_MARGIN
    return (F.when(spread == 0, "Flat (no rhythm)").when(diff > margin, "Residential feeder (drains AM, fills PM)")
            .when(diff < -margin, "Commuter core (fills AM, drains PM)").otherwise("Mixed/flat rhythm"))


def assign(shapes: DataFrame, model) -> DataFrame:
    """station_id, cluster, cluster_name; low-signal stations are -1."""
    from pyspark.ml.functions import array_to_vector

    centers = shapes.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    named = centers.select("cluster", name_cluster("center").alias("cluster_name"))
    model.setPredictionCol("cluster")
    hit = model.transform(shapes.filter("shape IS NOT NULL").withColumn("features", array_to_vector("shape"))).join(F.broadcast(named), "cluster")
    low = shapes.filter("is_low").select("station_id", F.lit(LOW_SIGNAL).alias("cluster"), F.lit("Low signal").alias("cluster_name"))
    return hit.select("station_id", "cluster", "cluster_name").unionByName(low)


def refit(daily: DataFrame, scale: float = 1.0, threshold: float = C.LOW_VOLUME, k_range=C.K_RANGE, restarts: int = C.RESTARTS) -> DataFrame:
    """station_id, cluster, cluster_name from the mean weekday curves of ``daily`` (date, hour, net) alone.

    An hour without a row is 0.  Where no k can be chosen every station is of low signal.
    """
    rows = daily.filter(S.day_type("date") == "weekday").groupBy("station_id", "hour").agg((F.avg("net") * scale).alias("value"))
    shapes = shape_matrix(flows.curves(rows, "station_id"), threshold)
    if shapes.filter("NOT is_low").count() <= k_range[0]:
        return shapes.select("station_id", F.lit(LOW_SIGNAL).alias("cluster"), F.lit("Low signal").alias("cluster_name"))
    return assign(shapes, select_k(shapes, k_range, restarts)[1])


def with_typology(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.select("station_id", "cluster"), "station_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(UNSEEN)))


def mean_curves(curves: DataFrame, labels: DataFrame) -> DataFrame:
    rows = curves.join(labels, "station_id").select("cluster", F.posexplode("curve").alias("hour", "value"))
    return rows.groupBy("cluster", "hour").agg(F.avg("value").alias("mean_value"))
