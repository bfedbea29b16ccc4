"""Boosted trees and additive models against plain NumPy versions of their definitions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import additive, boosting

GAP = boosting.MISSING


def table(seed, n):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 40, n) / 4, r.normal(size=n).round(1)
    kind = r.choice(list("pqrstuv"), n)
    rate = np.exp(0.1 * a - 0.5 * (b > 0.3) + np.isin(kind, list("qs")) * 0.8)
    y = r.poisson(rate)
    a = np.where(r.random(n) < 0.1, np.nan, a)
    return [(i, None if math.isnan(x) else float(x), float(v), None if i % 37 == 5 else str(k), float(c), float(c) - 2.0) for i, (x, v, k, c) in enumerate(zip(a, b, kind, y))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, a double, b double, kind string, y double, net double")


def binned(rows, bins):
    out = np.empty((3, len(rows)), int)
    for i, name in enumerate(("a", "b")):
        for j, r in enumerate(rows):
            out[i, j] = GAP if r[1 + i] is None else sum(e < r[1 + i] for e in bins.numeric[name])
    own = sorted({r[3] for r in rows if r[3] is not None})
    assert own == bins.classes["kind"]
    out[2] = [own.index(r[3]) if r[3] in own else GAP for r in rows]
    return out


def plain_split(x, g, h, rows, s):
    """(gain, feature, set of left bins) by trying every cut, each from the rows themselves."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2 + 1e-15)
    best = (0.0, None, None)
    for f in range(len(x)):
        bins, gap = x[f][rows], bool((x[f][rows] == GAP).any())
        if f < 2:
            top = max((b for b in bins if b != GAP), default=0)
            tries = [{*range(c + 1)} for c in range(top + gap)] + ([{*range(c + 1), GAP} for c in range(top + 1)] if gap else [])
        else:
            some = [b for b in sorted(set(bins)) if (bins == b).sum() >= 10]
            some.sort(key=lambda b: g[rows][bins == b].sum() / (h[rows][bins == b].sum() + 10))
            tries = [set(some[: i + 1]) for i in range(len(some))]
        for left in tries:
            m = np.isin(bins, list(left))
            lr, rr = rows[m], rows[~m]
            if min(len(lr), len(rr)) < s.min_samples_leaf or min(h[lr].sum(), h[rr].sum()) < 1e-3:
                continue
            gain = score(lr) + score(rr) - score(rows)
            if gain > best[0] + 1e-9 * max(1.0, best[0]):
                best = (gain, f, left)
    return best


def plain_boost(x, y, s, loss):
    """Raw values of all rows after every tree, grown one split at a time."""
    raw = np.full(len(y), math.log(y.mean()) if loss == "poisson" else y.mean())
    sizes = []
    for _ in range(s.max_iter):
        mean = np.exp(raw) if loss == "poisson" else raw
        g, h = mean - y, mean if loss == "poisson" else np.ones(len(y))
        may = lambda rows, d: len(rows) >= 2 * s.min_samples_leaf and (s.max_depth is None or d < s.max_depth)
        look = lambda rows, d: plain_split(x, g, h, rows, s) if may(rows, d) else (0.0, None, None)
        everything = np.arange(len(y))
        leaves = {"": (everything, *look(everything, 0))}
        while len(leaves) < s.max_leaf_nodes:
            p = min(leaves, key=lambda p: (-leaves[p][1], p))
            rows, gain, f, left = leaves[p]
            if gain <= 0:
                break
            m = np.isin(x[f][rows], list(left))
            del leaves[p]
            for side, part in (("L", rows[m]), ("R", rows[~m])):
                leaves[p + side] = (part, *look(part, len(p) + 1))
        for rows, *_ in leaves.values():
            raw[rows] += -s.learning_rate * g[rows].sum() / (h[rows].sum() + s.l2 + 1e-15)
        sizes.append(len(leaves))
    return raw, sizes


@pytest.mark.parametrize("loss,target,setting", [
    ("poisson", "y", boosting.Setting(max_iter=6, learning_rate=0.3, max_leaf_nodes=9, min_samples_leaf=15)),
    ("poisson", "y", boosting.Setting(max_iter=4, learning_rate=0.1, max_depth=2, min_samples_leaf=20)),
    ("squared", "net", boosting.Setting(max_iter=5, learning_rate=0.2, max_leaf_nodes=31, min_samples_leaf=20, l2=1.5)),
])
def test_trees_equal_the_plain_ones(spark, monkeypatch, loss, target, setting):
    monkeypatch.setattr(boosting, "FEW_ROWS", 200)  # several tasks
    rows = table(3, 900)
    df = frame(spark, rows)
    b = boosting.Boost(df, ["a", "b"], ["kind"], [target])
    (model,), (error,) = b.fit([boosting.Job(0, loss, setting, True)])
    assert error is None
    raw, sizes = plain_boost(binned(rows, b.bins), np.array([r[4] if target == "y" else r[5] for r in rows]), setting, loss)
    got = {r.id: r.p for r in model.transform(df, "p").collect()}
    want = np.exp(raw) if loss == "poisson" else raw
    assert np.allclose([got[i] for i in range(len(rows))], want, rtol=1e-9)
    assert [int((t.left == np.arange(len(t.left))).sum()) for t in model.trees] == sizes


def test_models_in_one_pass_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(boosting, "FEW_ROWS", 150)
    rows = table(5, 700)
    df = frame(spark, rows)
    recent = F.col("id") >= 600
    jobs = [boosting.Job(0, "poisson", boosting.Setting(max_iter=5, learning_rate=0.2, max_leaf_nodes=6), False), boosting.Job(1, "squared", boosting.Setting(max_iter=3, max_depth=3), False)]
    both, errors = boosting.Boost(df, ["a", "b"], ["kind"], ["y", "net"], recent).fit(jobs)
    for j, job in enumerate(jobs):
        (alone,), _ = boosting.Boost(df.filter(~recent), ["a", "b"], ["kind"], ["y", "net"]).fit([boosting.Job(job.target, job.loss, job.setting, True)])
        if boosting.find_bins(df, ["a", "b"], ["kind"]) == boosting.find_bins(df.filter(~recent), ["a", "b"], ["kind"]):
            p, q = ({r.id: r.p for r in m.transform(df, "p").collect()} for m in (both[j], alone))
            assert np.allclose([p[i] for i in range(700)], [q[i] for i in range(700)])
        own = both[j].transform(df.filter(recent), "p").agg(F.avg(F.abs(F.col("p") - F.col(["y", "net"][job.target])))).first()[0]
        assert errors[j] == pytest.approx(own, rel=1e-9)


def test_trees_stop_when_rows_put_aside_do_not_gain(spark):
    r = np.random.default_rng(8)
    rows = [(i, float(r.normal()), float(r.normal()), "k", float(r.poisson(2.0)), 0.0) for i in range(1500)]  # nothing to learn
    b = boosting.Boost(frame(spark, rows), ["a", "b"], ["kind"], ["y"], aside=F.col("id") % 10 == 0)
    (model, whole), _ = b.fit([boosting.Job(0, "poisson", boosting.Setting(max_iter=40, learning_rate=0.5, stop_from=100), True), boosting.Job(0, "poisson", boosting.Setting(max_iter=12, learning_rate=0.5), True)])
    assert 10 <= len(model.trees) < 20 and len(whole.trees) == 12


def test_trees_of_nothing(spark):
    none = boosting.Boost(frame(spark, []), ["a", "b"], ["kind"], ["y"])
    (model,), (error,) = none.fit([boosting.Job(0, "squared", boosting.Setting(max_iter=3), True)])
    assert error is None and model.trees == []
    got = model.transform(frame(spark, [(1, None, 2.0, "new", 0.0, 0.0)]), "p").collect()
    assert [r.p for r in got] == [0.0]
    few = boosting.Boost(frame(spark, table(1, 30)), ["a", "b"], ["kind"], ["y"])
    (model,), _ = few.fit([boosting.Job(0, "poisson", boosting.Setting(max_iter=3), True)])  # too few rows for a split
    assert all(t.depth == 0 for t in model.trees)


# --- additive models ---------------------------------------------------------------------------------------------------------


def weather_rows(n=600, seed=2):
    r = np.random.default_rng(seed)
    return [(float(r.uniform(-5, 30)), int(r.integers(0, 24)), str(r.choice(["Mon", "Tue", "Sat"])), None if r.random() < 0.1 else str(r.integers(0, 3)), float(r.integers(0, 2)), float(r.poisson(3 + 2 * np.sin(i / 9)))) for i in range(n)]


def b_splines(x, t, degree=3):
    """Basis values at ``x`` on the knots ``t`` by the recursion itself."""
    out = [float(t[i] <= x < t[i + 1]) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        out = [(x - t[i]) / (t[i + d] - t[i]) * out[i] + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * out[i + 1] for i in range(len(t) - d - 1)]
    return out


def plain_design(rows):
    lo, hi = min(r[0] for r in rows), max(r[0] for r in rows)
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    step, turn = (hi - lo) / 4, (last - first) / 5
    open_knots = [lo + step * i for i in range(-3, 8)]
    cycle_knots = [first + turn * i for i in range(-3, 9)]
    kinds = [sorted({r[2] for r in rows}), sorted({r[3] or additive.NONE for r in rows})]
    out = []
    for t, h, d, k, hol, _ in rows:
        own = b_splines(min(max(t, lo), hi - 1e-12 * (hi - lo)), open_knots)
        round_ = np.zeros(5)
        for i, v in enumerate(b_splines(first + (h - first) % (last - first), cycle_knots)):
            round_[(i - 3) % 5] += v
        out.append([*own, *round_, *(float(d == v) for v in kinds[0]), *(float((k or additive.NONE) == v) for v in kinds[1]), hol])
    return np.array(out)


@pytest.mark.parametrize("counts", [True, False])
def test_additive_model_equals_the_plain_one(spark, counts):
    rows = weather_rows()
    df = spark.createDataFrame(rows, "temp double, hour int, day string, kind string, holiday double, y double").repartition(3)
    how = additive.design(df, "temp", "hour", ["day", "kind"], ["holiday"])
    m = additive.fit(df, "y", how, counts)
    x, y = plain_design(rows), np.array([r[5] for r in rows])
    got = np.array(df.select(F.array(*how.columns()).alias("x"), "temp", "hour").orderBy("temp").toPandas()["x"].tolist())
    order = np.argsort([r[0] for r in rows])
    assert np.allclose(got[:, :7], x[order][:, :7], atol=1e-9) and np.allclose(np.sort(got[:, 7:12], axis=1), np.sort(x[order][:, 7:12], axis=1), atol=1e-9) and np.allclose(got[:, 12:], x[order][:, 12:])
    z, penalty = np.concatenate([np.ones((len(y), 1)), x], axis=1), np.r_[0.0, np.ones(x.shape[1])]
    if counts:
        b = np.r_[math.log(y.mean()), np.zeros(x.shape[1])]
        for _ in range(200):
            mu = np.exp(z @ b)
            b = b - np.linalg.solve((z * mu[:, None]).T @ z / len(y) + np.diag(penalty), z.T @ (mu - y) / len(y) + penalty * b)
        want = np.exp(z @ b)
    else:
        b = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
        want = z @ b
    assert m.intercept == pytest.approx(b[0], abs=1e-6)
    assert np.allclose(np.sort(m.weights), np.sort(b[1:]), atol=1e-6)
    p = [r.p for r in df.withColumn("p", m.column()).orderBy("temp").collect()]
    assert np.allclose(p, want[order], atol=1e-6)
    # a class not seen adds nothing, temperatures beyond the ends count as the ends
    edge = spark.createDataFrame([(99.0, 3, "Sun", "x", 0.0, 0.0), (max(r[0] for r in rows), 3, "Sun", "x", 0.0, 0.0)], df.schema)
    a, b = [r.p for r in edge.withColumn("p", m.column()).collect()]
    assert a == pytest.approx(b)


def test_additive_model_of_nothing(spark):
    df = spark.createDataFrame([], "temp double, hour int, day string, kind string, holiday double, y double")
    how = additive.design(df, "temp", "hour", ["day", "kind"], ["holiday"])
    for counts in (True, False):
        m = additive.fit(df, "y", how, counts)
        assert m.intercept == pytest.approx(math.log(1e-15) if counts else 0.0) and not m.weights.any()
