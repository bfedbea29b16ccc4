"""Regressions from mergeable sums, rank correlation, signed-rank test."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel import constants as C
from tidewheel.operators.ordered import ordered


def ols(df: DataFrame, y: str, xs: list[str]) -> dict | None:
    """Least squares with intercept: coefficients, covariance, n, R^2; None if rank-deficient or n <= p.

    X'X, X'y and y'y are sums, so one aggregation over the data and a p x p solve on the driver.
    """
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    p = len(cols)
    t = F.col(y).cast("double")
    ok = t.isNotNull()
    for x in xs:
        ok &= F.col(x).isNotNull()
    sums = [F.sum(cols[i] * cols[j]) for i in range(p) for j in range(i, p)] + [F.sum(c * t) for c in cols] + [F.sum(t * t), F.sum(t), F.count("*")]
    row = list(df.filter(ok).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    n = row[-1]
    if n <= p:
        return None
    a = np.zeros((p, p))
    k = 0
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = row[k]
            k += 1
    b = np.array(row[k : k + p], float)
    scale = np.sqrt(np.diag(a))
    if (scale == 0).any() or np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-10) < p:
        return None
    beta = np.linalg.solve(a, b)
    rss = max(0.0, row[k + p] - beta @ b)
    inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    tss = row[k + p] - row[k + p + 1] ** 2 / n
    return {"beta": beta, "cov": rss / (n - p) * inverse, "n": n, "r2": 1 - rss / tss if tss > 0 else None}


def regress2(df: DataFrame, y: str, a: str, b: str, *keys: str) -> DataFrame:
    """y on two regressors for every key at once, in closed form from centred sums: b0, b1, b2, se1, se2, r2, n.

    Null coefficients where the regressors are collinear or n <= 3.
    """
    v = {c: F.col(c).cast("double") for c in (y, a, b)}
    names = [y, a, b]
    rows = df.filter(v[y].isNotNull() & v[a].isNotNull() & v[b].isNotNull())
    sums = {f"s{i}": F.sum(v[c]) for i, c in enumerate(names)} | {f"q{i}{j}": F.sum(v[names[i]] * v[names[j]]) for i in range(3) for j in range(i, 3)}
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[s.alias(k) for k, s in sums.items()])
    c = lambda i, j: F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")
    g = g.withColumns({"yy": c(0, 0), "ya": c(0, 1), "yb": c(0, 2), "aa": c(1, 1), "ab": c(1, 2), "bb": c(2, 2)})
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    g = g.withColumn("det", F.when((det > 1e-9 * F.col("aa") * F.col("bb")) & (F.col("n") > 3), det))
    g = g.withColumns({"b1": (F.col("bb") * F.col("ya") - F.col("ab") * F.col("yb")) / F.col("det"), "b2": (F.col("aa") * F.col("yb") - F.col("ab") * F.col("ya")) / F.col("det")})
    g = g.withColumn("rss", F.greatest(F.lit(0.0), F.col("yy") - F.col("b1") * F.col("ya") - F.col("b2") * F.col("yb")))
    s2 = F.col("rss") / (F.col("n") - 3)
    return g.select(
        *keys, "n", ((F.col("s0") - F.col("b1") * F.col("s1") - F.col("b2") * F.col("s2")) / F.col("n")).alias("b0"), "b1", "b2",
        F.sqrt(s2 * F.col("bb") / F.col("det")).alias("se1"), F.sqrt(s2 * F.col("aa") / F.col("det")).alias("se2"), (1 - F.try_divide("rss", "yy")).alias("r2"))


def local_slope(b1, b2, capacity) -> Column:
    return b1 + 2 * b2 * capacity


def local_slope_se(v1, v2, c12, capacity) -> Column:
    return F.sqrt(v1 + 4 * capacity * capacity * v2 + 4 * capacity * c12)


def ci95(slope: Column, se: Column, denominator: Column) -> tuple[Column, Column]:
    return F.bround((slope - C.Z95 * se) / denominator, 4), F.bround((slope + C.Z95 * se) / denominator, 4)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks on ties; null with fewer than three pairs.

    Ranks come from counts per distinct value, added up over ranges of values.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)

    def ranks(c: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count("*").alias("n"))
        return ordered(n, [c], sums={"upto": "n"}).select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"_{c}"))

    r = rows.join(ranks(a), a).join(ranks(b), b)
    return r.agg(F.when(F.count("*") >= 3, F.corr(f"_{a}", f"_{b}")).alias("rho"), F.count("*").alias("n"))


def wilcoxon(a: list[float], b: list[float]) -> tuple[float, float] | None:
    """Two-sided signed-rank statistic and p-value, exact null by subset sums; None without variation.

    Zero differences are dropped; the exact null needs distinct ranks, ties take average ranks.
    """
    d = [x - y for x, y in zip(a, b) if x != y]
    if len(a) < 2 or not d:
        return None
    size = np.abs(d)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    plus = float(rank[np.array(d) > 0].sum())
    stat = min(plus, float(rank.sum()) - plus)
    ways = {0.0: 1}
    for r in rank:
        new = dict(ways)
        for s, w in ways.items():
            new[s + r] = new.get(s + r, 0) + w
        ways = new
    low = sum(w for s, w in ways.items() if s <= stat + 1e-9)
    return stat, min(1.0, 2 * low / 2 ** len(rank))


def capacity_reliability(stations: DataFrame, gap_docks: int = 20, headline: float = 0.5) -> DataFrame:
    """Unusable rate on capacity and log demand: slope per dock, its error, the modelled gap in points, whether it is a headline."""
    r = regress2(stations.withColumn("log_demand", F.log1p("demand")), "unusable_rate", "capacity", "log_demand")
    gap = -F.col("b1") * gap_docks * 100
    return r.select("n", F.col("b1").alias("rate_per_dock"), F.col("se1").alias("rate_per_dock_se"), gap.alias("reliability_gap_points"), (gap > headline).alias("headline"))


def bands(stations: DataFrame) -> DataFrame:
    """Stations and mean rate by capacity band; an empty band stays, with a null mean."""
    lo, hi = C.BAND_EDGES
    band = F.when(F.col("capacity") < lo, f"<{lo}").when(F.col("capacity") < hi, f"{lo}-{hi - 1}").otherwise(f"{hi}+")
    rows = stations.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("unusable_rate").alias("mean_rate"))
    all_bands = stations.sparkSession.createDataFrame([(f"<{lo}",), (f"{lo}-{hi - 1}",), (f"{hi}+",)], "band string")
    return all_bands.join(rows, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), "mean_rate")
