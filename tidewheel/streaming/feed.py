"""The two station feeds as a stream: polls are spooled before they are offered, so every offset can be read again.

    <spool>/000000000007-1700000420.json      the 7th poll that was new, as the feed gave it, with its ``last_updated``

A live status feed only has its present state.  The reader polls it when Spark asks for the newest offset, and puts a poll that it has not
seen into the spool under the next number, whole or not at all, before it tells that number.  An offset is a number; a batch is the polls between
two of them, dealt to at most ``MOST_TASKS`` tasks that read the spool.  A query that starts again from its checkpoint therefore reads the same polls again,
and a poll that comes twice (the same ``last_updated``) is one.  A poll that is older than the last one (a cached answer) is a
poll of its own: its rows carry their own time, and watermarks decide about them.

Without a ``status`` address the spool is only read, for feeds that another process spools.  Equal to reading all polls as one batch.

Defined results: a poll without stations gives no rows; a station without a number has nulls; what is not a spooled poll in the folder is
not read; a poll that is no feed fails the query before it is spooled.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewheel.session import prepare_workers
from tidewheel.sources import files, landing

READINGS = "feed_id string, timestamp timestamp, bikes_available int, docks_available int, is_renting int, is_returning int, poll long"
MOST_TASKS = 64
KEPT = 1000  # polls whose files stay behind the last committed batch, so that repeats are still known


class StationFeed(DataSource):
    """Options: spool (a folder all executors reach), status (address of the live feed; none: the spool is only read), kept."""

    @classmethod
    def name(cls) -> str:
        return "station_feed"

    def schema(self) -> str:
        return READINGS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options.get("spool"), self.options.get("status"), int(self.options.get("kept", KEPT)))


class _Polls(InputPartition):
    def __init__(self, polls: list[tuple[int, str]]):
        self.polls = polls


class _Reader(DataSourceStreamReader):
    def __init__(self, spool: str, status: str | None, kept: int):
        self.spool, self.status, self.kept = spool, status, kept

    def _polls(self) -> dict[int, tuple[int, str]]:
        """number -> (last_updated, path) of what is spooled."""
        from pyarrow import fs as pfs

        fs, folder = landing.arrow_fs(self.spool)
        found = {}
        for f in fs.get_file_info(pfs.FileSelector(folder, allow_not_found=True)):
            number, _, at = f.base_name.removesuffix(".json").partition("-")
            if f.is_file and f.base_name.endswith(".json") and number.isdigit() and at.isdigit():
                found[int(number)] = (int(at), f.path)
        return found

    def _poll(self, known: dict[int, tuple[int, str]]) -> int:
        """Ask the feed once; the number of its poll if it is new, else the newest one."""
        body = b"".join(landing.fetch(self.status))
        at = int(json.loads(body)["last_updated"])
        newest = max(known, default=0)
        if any(seen == at for seen, _ in known.values()):
            return newest
        fs, folder = landing.arrow_fs(self.spool)
        fs.create_dir(folder, recursive=True)
        part = f"{folder}/.part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(body)
        fs.move(part, f"{folder}/{newest + 1:012d}-{at}.json")
        return newest + 1

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        known = self._polls()
        return {"poll": self._poll(known) if self.status else max(known, default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Polls]:
        new = [(n, path) for n, (_, path) in sorted(self._polls().items()) if start["poll"] < n <= end["poll"]]
        size = -(-len(new) // MOST_TASKS) or 1
        return [_Polls(new[i : i + size]) for i in range(0, len(new), size)]

    def read(self, partition: _Polls) -> Iterator[tuple]:
        import datetime as dt

        fs, _ = landing.arrow_fs(self.spool)
        for number, path in partition.polls if partition is not None else ():
            with fs.open_input_stream(path) as f:
                poll = json.loads(f.read())
            at = dt.datetime.fromtimestamp(poll["last_updated"], dt.timezone.utc)
            for s in poll["data"]["stations"]:
                yield (s.get("station_id"), at, *(s.get(k) for k in ("num_bikes_available", "num_docks_available", "is_renting", "is_returning")), number)

    def commit(self, end: dict) -> None:
        if self.status:
            fs, _ = landing.arrow_fs(self.spool)
            for number, (_, path) in self._polls().items():
                if number <= end["poll"] - self.kept:
                    fs.delete_file(path)


def readings(spark: SparkSession, spool: str, status: str | None = None, kept: int = KEPT) -> DataFrame:
    """The stream of all polls of a spool, and of a live feed if its address is given."""
    prepare_workers(spark)
    spark.dataSource.register(StationFeed)
    reader = spark.readStream.format("station_feed").option("spool", files.as_uri(spool)).option("kept", str(kept))
    return (reader.option("status", status) if status else reader).load()


def crosswalk(status: DataFrame, information: DataFrame) -> DataFrame:
    """Readings by station id (a stream-static join by feed id); readings of stations that the information feed lacks are dropped."""
    return status.join(information.select("feed_id", "station_id"), "feed_id")


def spooled(spark: SparkSession, spool: str) -> DataFrame:
    """All polls of a spool as one batch: what a stream over it gives in the end."""
    kind = "last_updated long, data struct<stations: array<struct<station_id: string, num_bikes_available: int, num_docks_available: int, is_renting: int, is_returning: int>>>"
    docs = spark.read.schema(kind).option("pathGlobFilter", "[0-9]*-[0-9]*.json").json(files.as_uri(spool), multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    rows = docs.select(F.timestamp_seconds("last_updated").alias("timestamp"), F.regexp_extract("file", "^([0-9]+)-", 1).cast("long").alias("poll"), F.explode("data.stations").alias("s"))
    return rows.select(F.col("s.station_id").alias("feed_id"), "timestamp", F.col("s.num_bikes_available").alias("bikes_available"), F.col("s.num_docks_available").alias("docks_available"), "s.is_renting", "s.is_returning", "poll")
