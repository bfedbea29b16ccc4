"""Clustering input is computed once, and the silhouette compares blocks, in any number."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import typology


def test_silhouette_of_many_blocks_is_that_of_one(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(c), [float(x) for x in v]) for c, v in zip(r.integers(0, 3, 90), r.normal(size=(90, 4)))]
    df = spark.createDataFrame(rows, "label int, shape array<double>").repartition(3)
    whole = typology.silhouette(df)
    monkeypatch.setattr(typology, "BLOCK", 7)
    assert typology.silhouette(df) == pytest.approx(whole, rel=1e-12)
    assert typology.silhouette(df.filter("label = 1")) == 0.0 and typology.silhouette(df.limit(0)) is None


def test_shapes_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i % 3) + i / 100

    curves = spark.range(12).repartition(2).withColumn("v", value.asNondeterministic()("id"))
    shapes = curves.select(F.col("id").alias("station_id"), F.lit(False).alias("is_low"), F.array("v", F.lit(1.0)).alias("shape"))
    typology.select_k(shapes, (2, 3), restarts=1)
    assert seen.value == 12


def test_scores_do_not_depend_on_where_rows_lie(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(30, 5)))]
    scores = []
    for seed in range(3):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "station_id int, shape array<double>").repartition(seed + 1)
        scores.append(typology.select_k(df, (4, 6), restarts=1)[2])
    assert scores[0] == pytest.approx(scores[1], rel=1e-12) and scores[0] == pytest.approx(scores[2], rel=1e-12)
