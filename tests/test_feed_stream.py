"""The feed as a stream: repeated and late polls, restart from the offset, replay, equal to one batch."""
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewheel.sources import files
from tidewheel.streaming import feed


def poll(at, *bikes):
    return {"last_updated": at, "data": {"stations": [{"station_id": f"f{i}", "num_bikes_available": b, "num_docks_available": 9, "is_renting": 1, "is_returning": 1} for i, b in enumerate(bikes)]}}


class Feed:
    """A status feed that is a file, and a stream over it that runs once a poll."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.status = folder / "status.json"

    def show(self, p):
        self.status.write_text(json.dumps(p) if isinstance(p, dict) else p)

    def run(self, spool="spool", live=True, name="out", kept=1000):
        """One start of the query: everything that is new, then it ends."""
        rows = feed.readings(self.spark, str(self.folder / spool), f"file://{self.status}" if live else None, kept)
        q = rows.writeStream.format("parquet").option("path", str(self.folder / name)).option("checkpointLocation", str(self.folder / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()

    def rows(self, name="out"):
        got = self.spark.read.schema(feed.READINGS).parquet(str(self.folder / name)).select("feed_id", F.unix_timestamp("timestamp").alias("at"), "bikes_available", "poll")
        return Counter((r.feed_id, r.at, r.bikes_available, r.poll) for r in got.collect())


@pytest.fixture
def live(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_repeated_and_late_polls(live):
    want = Counter()
    for number, p in ((1, poll(1000, 5, 0)), (1, poll(1000, 5, 0)), (2, poll(1600, 4)), (3, poll(1300, 7, 7)), (2, poll(1600, 4)), (4, poll(1900))):
        live.show(p)
        live.run()  # each is a start from the checkpoint
        for s in p["data"]["stations"]:
            want[s["station_id"], p["last_updated"], s["num_bikes_available"], number] = 1
    assert live.rows() == want
    assert len(files.names(live.spark, str(live.folder / "spool"))) >= 4
    batch = feed.spooled(live.spark, str(live.folder / "spool")).select("feed_id", F.unix_timestamp("timestamp").alias("at"), "bikes_available", "poll")
    assert Counter(tuple(r) for r in batch.collect()) == want  # the same as one batch


def test_a_new_query_replays_the_spool(live):
    for at in (1000, 1600, 2200):
        live.show(poll(at, at % 7))
        live.run()
    live.run(live=False, name="again")  # another query with a state of its own, without the live feed
    assert live.rows("again") == live.rows() and len(live.rows()) == 3


def test_a_lost_batch_is_read_again(spark, live):
    """The sink's state falls back to an earlier offset: the same polls come again from the spool, whatever the feed shows now."""
    seen, broken = [], [True]

    def sink(batch, number):
        rows = sorted((r.poll, r.feed_id, r.bikes_available) for r in batch.collect())
        if broken[0] and rows and rows[0][0] == 2:
            raise RuntimeError("killed")
        seen.append((number, rows))

    def run():
        q = feed.readings(spark, str(live.folder / "spool"), f"file://{live.status}").writeStream.foreachBatch(sink).option("checkpointLocation", str(live.folder / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    live.show(poll(1000, 1))
    run()
    live.show(poll(1600, 2))
    with pytest.raises(Exception, match="killed"):
        run()
    live.show(poll(2200, 3))  # the feed went on while the query was down
    broken[0] = False
    run()
    run()
    assert [r for _, rows in seen for r in rows] == [(1, "f0", 1), (2, "f0", 2), (3, "f0", 3)]


def test_old_polls_leave_the_spool(live):
    for i in range(6):
        live.show(poll(1000 + i, i))
        live.run(kept=2)
    names = [n for n in files.names(live.spark, str(live.folder / "spool")) if n.endswith(".json")]
    assert 2 <= len(names) <= 4 and live.rows() == Counter({("f0", 1000 + i, i, i + 1): 1 for i in range(6)})


def test_what_is_no_feed_is_not_spooled(live):
    live.show("<html>busy</html>")
    with pytest.raises(Exception):
        live.run()
    assert not [n for n in files.names(live.spark, str(live.folder / "spool")) if n.endswith(".json")]
    live.show(poll(1000, 5))
    live.run()
    assert live.rows() == Counter({("f0", 1000, 5, 1): 1})


def test_crosswalk_drops_unknown_stations(spark, live):
    live.show(poll(1000, 5, 6))
    live.run()
    info = spark.createDataFrame([("f1", "6433.01")], "feed_id string, station_id string")
    got = feed.crosswalk(feed.spooled(spark, str(live.folder / "spool")), info).collect()
    assert [(r.station_id, r.bikes_available) for r in got] == [("6433.01", 6)]
    assert feed.crosswalk(feed.readings(spark, str(live.folder / "spool")), info).isStreaming
