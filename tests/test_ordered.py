"""Ordered passes and quantiles over ranges against sorting everything in plain Python."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators.ordered import ordered, quantile


@pytest.mark.parametrize("n,kinds,ranges", [(0, 5, 4), (1, 5, 4), (500, 1000, 7), (500, 3, 6), (40, 1, 3)])
def test_ordered(spark, n, kinds, ranges):
    r = random.Random(n)
    rows = [(r.randrange(kinds), i, None if i % 9 == 4 else r.randrange(100)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(5)
    got = sorted(ordered(df, [F.desc("k"), "i"], number="place", sums={"upto": "v"}, nexts={"after": "i", "after_k": "k"}, ranges=ranges).collect(), key=lambda x: x.place)
    want, total = sorted(rows, key=lambda x: (-x[0], x[1])), 0
    assert [x.place for x in got] == list(range(1, n + 1))
    for j, (x, w) in enumerate(zip(got, want)):
        total += w[2] or 0
        nxt = want[j + 1] if j + 1 < n else (None, None)
        assert (x.k, x.i, x.v, x.upto, x.after, x.after_k) == (*w, total, nxt[1], nxt[0])


@pytest.mark.parametrize("accuracy", [20, 10_000])  # a rough sketch leaves a bracket, a fine one takes all of a small table
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantiles(spark, q, accuracy):
    r = np.random.default_rng(7)
    rows = [("a", float(v)) for v in r.normal(size=2001)] + [("b", float(v)) for v in r.integers(0, 4, 1500)] + [(None, 3.5), ("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {x.g: x["quantile"] for x in quantile(df, "v", q, ["g"], accuracy=accuracy).collect()}
    values = lambda g: [v for k, v in rows if k == g and v is not None]
    assert set(got) == {"a", "b", None}
    for g in got:
        assert got[g] == pytest.approx(np.quantile(values(g), q), abs=1e-12)
    every = [v for _, v in rows if v is not None]
    assert [x["quantile"] for x in quantile(df, "v", q, accuracy=accuracy).collect()] == [pytest.approx(np.quantile(every, q), abs=1e-12)]


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([("c", None)], "g string, v double")
    assert [x["quantile"] for x in quantile(df, "v", 0.5).collect()] == [None]
    assert quantile(df, "v", 0.5, ["g"]).collect() == []


def test_no_window_orders_everything(spark, monkeypatch):
    """Every window of the ordered passes has a partition key."""
    from tidewheel.operators import ordered as module

    plans, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    df = spark.range(1000).select((F.col("id") % 37).alias("v"), (F.col("id") % 3).alias("g"))
    last = [ordered(df, ["v"], number="n", sums={"s": "v"}, nexts={"x": "v"}), quantile(df, "v", 0.5, accuracy=20), quantile(df, "v", 0.5, ["g"], accuracy=20)]
    plans += [f._jdf.queryExecution().optimizedPlan().toString() for f in last]
    windows = [line for p in plans for line in p.splitlines() if "Window [" in line]
    assert windows and all("windowspecdefinition(_range" in w or f"windowspecdefinition(g" in w for w in windows)
