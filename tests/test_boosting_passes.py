"""Boosted trees: small subtrees are finished in one pass and are those that passes for every level find."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import boosting


@pytest.fixture
def rows(spark):
    r = spark.range(3_000).withColumns({"a": F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.pmod(F.hash("id"), F.lit(400)) / 7.0), "b": F.pmod(F.hash(F.col("id") + 1), F.lit(30)).cast("double"), "kind": F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))})
    return r.withColumns({"net": F.col("b") * 2 - F.coalesce("a", F.lit(9.0)) + F.pmod(F.hash(F.col("id") + 2), F.lit(11)), "y": F.floor(F.col("b") / 6 + F.pmod(F.hash(F.col("id") + 3), F.lit(3))).cast("double")}).cache()


JOBS = [boosting.Job(0, "poisson", boosting.Setting(max_iter=4, learning_rate=0.2), True), boosting.Job(1, "squared", boosting.Setting(max_iter=3, max_depth=4, l2=0.5), True)]


def test_a_tree_of_few_rows_takes_one_pass(rows, monkeypatch):
    monkeypatch.setattr(boosting, "FEW_ROWS", 700)  # several tasks
    passes, summed = [], boosting.Boost._summed
    monkeypatch.setattr(boosting.Boost, "_summed", lambda *a: passes.append(1) or summed(*a))
    models, _ = boosting.Boost(rows, ["a", "b"], ["kind"], ["y", "net"]).fit(JOBS)
    assert [len(m.trees) for m in models] == [4, 3] and max(t.depth for m in models for t in m.trees) > 3
    assert len(passes) == 4 + 2  # a pass a round, one for the counts and one for the errors


@pytest.mark.parametrize("small", [0, 40, 900])
def test_same_trees_by_levels_and_by_subtrees(rows, monkeypatch, small):
    monkeypatch.setattr(boosting, "FEW_ROWS", 700)
    b = boosting.Boost(rows, ["a", "b"], ["kind"], ["y", "net"])
    whole, errors = b.fit(JOBS)
    monkeypatch.setattr(boosting, "SMALL", small)
    parts, other = b.fit(JOBS)
    for one, two in zip(whole, parts):
        for s, t in zip(one.trees, two.trees):
            assert np.array_equal(s.feature, t.feature) and np.array_equal(s.goes_left, t.goes_left) and np.array_equal(s.left, t.left)
            assert np.allclose(s.value, t.value, rtol=1e-9)
    assert errors == other == [None, None]
