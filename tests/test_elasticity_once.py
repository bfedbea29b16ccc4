"""What many fits read is computed once."""
from pyspark.sql import functions as F

from tidewheel.operators import elasticity, stats


def test_fits_read_what_was_computed_once(spark, monkeypatch):
    seen, real = [], stats.regress2

    def regress2(df, *args):
        seen.append(df)
        return real(df, *args)

    monkeypatch.setattr(stats, "regress2", regress2)
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        runs.add(1)
        return name

    name = elasticity.NAMED[0]
    roster = spark.createDataFrame([(f"s{i}", name, 2.0 + i, 10 + i, 5.0 + i % 3) for i in range(8)], "station_id string, cluster_name string, magnitude double, capacity int, throughput double")
    roster = roster.withColumn("cluster_name", counted("cluster_name"))
    days = spark.range(12).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), (F.col("id") % 5).cast("double").alias("temp_mean_c"), (F.col("id") % 3).cast("double").alias("precip_mm"), "id")
    panel = roster.select("station_id").join(days).withColumn("magnitude", F.col("id") * 0.5 + F.length("station_id")).drop("id")
    types, stations = elasticity.elasticities(roster, panel)
    assert (types.count(), stations.count()) == (1, 8)
    assert runs.value <= 4 * 8  # the filter and the column of one pass, not one of each fit
    assert len(seen) == 2 and all(d.inputFiles() == [] and "Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
