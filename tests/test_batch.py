"""Interrupted batches: whatever is killed, each id is answered and stored once."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import batch


def records(spark, n=25, changed=()):
    r = spark.range(n).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("station_id"), F.when(F.col("id").isin(list(changed)), "new").otherwise("old").alias("v"))
    return r.select("station_id", F.sha2(F.concat("station_id", "v"), 256).alias("facts_hash"), F.struct("v").alias("record"))


def by_python(log, dies_at=None, leaves=()):
    """Answers row by row in Python workers, noting each call in a file; dies at one station, gives no answer for some."""
    def answer(requests):
        def each(batches):
            for pdf in batches:
                for row in pdf.itertuples():
                    if row.station_id == dies_at:
                        raise RuntimeError("killed")
                    with open(log, "a") as f:
                        f.write(row.station_id + "\n")
                kept = pdf[~pdf["station_id"].isin(list(leaves))]
                yield kept[["part", "custom_id"]].assign(text="text of " + kept["station_id"], source="first")

        return requests.drop("record").mapInPandas(each, batch.RESULT)

    return answer


def fallback(requests):
    return requests.select("part", "custom_id", F.lit("plain").alias("text"), F.lit("template").alias("source"))


def test_killed_and_taken_up_again(spark, tmp_path):
    path, log = str(tmp_path / "b"), str(tmp_path / "log")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="killed"):
        batch.run(spark, path, records(spark), [by_python(log, dies_at="k023")], rows_per_part=5)  # in the fifth part, which starts when one of four cores is through with another
    assert batch.state(spark, path) == (1, True) and batch.stored(spark, path).count() == 0
    done = batch.results(spark, path, 1).count()
    assert 0 < done < 25 and done % 5 == 0  # whole parts
    asked = set(open(log).read().split())
    os.remove(log)
    # records change while the batch is open: it goes on with those it was planned for
    got = batch.run(spark, path, records(spark, changed=[3]), [by_python(log)], rows_per_part=7)
    assert len(open(log).read().split()) == 25 - done
    rows = got.collect()
    assert sorted(r.station_id for r in rows) == [f"k{i:03d}" for i in range(25)] and {r.text for r in rows} == {f"text of k{i:03d}" for i in range(25)}
    assert asked and batch.state(spark, path) == (1, False) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == old
    # the change is sent by the next one
    rows = {r.station_id: (r.source, r.batch) for r in batch.run(spark, path, records(spark, changed=[3]), [fallback]).collect()}
    assert {k for k, v in rows.items() if v == ("template", 2)} == {"k003"} and len(rows) == 25


def test_left_answers_gone_and_unchanged_stations(spark, tmp_path):
    path, log = str(tmp_path / "b"), str(tmp_path / "log")
    with pytest.raises(RuntimeError, match="waits for 2"):
        batch.run(spark, path, records(spark, 10), [by_python(log, leaves=("k001", "k008"))], rows_per_part=4)
    got = batch.run(spark, path, records(spark, 10), [by_python(log, leaves=("k001",)), fallback], rows_per_part=4)
    assert {(r.source, r.n) for r in batch.summary(got).collect()} == {("first", 9), ("template", 1)}
    assert sorted(open(log).read().split()) == sorted([f"k{i:03d}" for i in range(10)] + ["k001", "k008"])
    assert batch.run(spark, path, records(spark, 10), [fallback]).count() == 10 and batch.state(spark, path) == (1, False)  # nothing changed
    assert sorted(r.station_id for r in batch.run(spark, path, records(spark, 6, changed=[2]), [fallback]).filter("batch = 1").collect()) == ["k000", "k001", "k003", "k004", "k005"]


def test_answers_that_came_twice_count_once(spark, tmp_path):
    path, log = str(tmp_path / "b"), str(tmp_path / "log")
    assert batch.plan(spark, path, records(spark, 9), rows_per_part=3) == 1 == batch.plan(spark, path, records(spark, 12), rows_per_part=2)
    batch.work(spark, path, by_python(log))
    for f in glob.glob(f"{path}/00000001/results/part-*.parquet"):  # a second attempt's files, and what a killed one left
        name = os.path.basename(f).rsplit("-", 1)[0]
        for other in (f"{name}-{'0' * 32}.parquet", f".{name}-{'1' * 32}.parquet"):
            with open(f, "rb") as a, open(f"{path}/00000001/results/{other}", "wb") as b:
                b.write(a.read())
    assert batch.results(spark, path, 1).count() == 9 and batch.close(spark, path, records(spark, 9)) == 1
    assert batch.stored(spark, path).count() == 9 == batch.stored(spark, path).select("station_id").distinct().count()


def test_planned_but_not_opened(spark, tmp_path):
    path = str(tmp_path / "b")
    os.makedirs(f"{path}/00000001/requests-dead")  # killed before the batch was opened
    assert batch.state(spark, path) == (0, False)
    assert batch.run(spark, path, records(spark, 0), [fallback]).count() == 0 and batch.state(spark, path) == (0, False)
    assert batch.run(spark, path, records(spark, 3), [fallback]).count() == 3 and batch.state(spark, path) == (1, False)


def test_many_parts_share_tasks(spark, tmp_path):
    """A task's fixed cost is not paid for each part; each part still is a file of its own."""
    path, tracker = str(tmp_path / "b"), spark.sparkContext.statusTracker()
    batch.plan(spark, path, records(spark, 100), rows_per_part=2)
    spark.sparkContext.setJobGroup("many parts", "")
    assert batch.work(spark, path, fallback) == 0
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many parts") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext._jsc.clearJobGroup()
    assert max(s.numTasks for s in stages if s) <= batch.PARTS_AT_ONCE * spark.sparkContext.defaultParallelism < 50
    files = glob.glob(f"{path}/00000001/results/part-*.parquet")
    assert len(files) == 50 and sorted(os.path.basename(f)[:13] for f in files) == [f"part-{i:08d}" for i in range(50)]
    assert batch.results(spark, path, 1).count() == 100
