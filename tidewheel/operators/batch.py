"""A batch of texts that can be interrupted anywhere and taken up again; only records that changed are sent.

    <path>/00000003/opened.json        {"requests": "requests-<id>", "n_parts": 12}: what is asked for, fixed when the batch was planned
                   /results/part-...   one file for each part that is through, written by its task
                   /closed.json        {"stored": "stored-<id>"}: every text there is after this batch

A batch is open from the rename of ``opened.json`` to that of ``closed.json``.  While it is open nothing is planned anew: a
later run asks for what has no result yet.  A task owns the part of its rows and gives its file its name when the part is through, so what
a killed job, executor or driver leaves undone is the parts in flight.  An answer that came twice (a task that ran twice, two runs
at a time) counts once, the earlier one, so each id has one text.  The record's hash is kept with the request: if a record
changes while its batch is open, the next batch sends it again.

Defined results: without changes no batch is opened; a request without an answer (null text, or dropped) stays open; records
that are gone lose their text at the next close; stations whose record did not change keep theirs, with the batch that wrote it.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidewheel.operators import facts as facts_of
from tidewheel.operators.ordered import ordered
from tidewheel.session import prepare_workers
from tidewheel.sources import files
from tidewheel.sources.landing import arrow_fs

STORED = "station_id string, text string, source string, facts_hash string, batch long"
RESULT = "part int, custom_id string, text string, source string"
PARTS_AT_ONCE = 4
OPENED, CLOSED = "opened.json", "closed.json"


class Results(DataSource):
    """Sink of answers: options ``folder`` and ``round``."""

    @classmethod
    def name(cls) -> str:
        return "batch_results"

    def schema(self) -> str:
        return RESULT

    def writer(self, schema, overwrite: bool):
        return _ResultWriter(self.options["folder"], int(self.options["round"]))


@dataclass
class _Written(WriterCommitMessage):
    n: int


class _ResultWriter(DataSourceArrowWriter):
    """Writes each part that comes whole to this task; a file has its name from the moment its part is through, whatever becomes of the job."""

    def __init__(self, folder: str, number: int):
        self.folder, self.number = folder, number

    def write(self, iterator: Iterator) -> _Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        fs, folder = arrow_fs(self.folder)
        part, writer, own, n = None, None, None, 0

        def end():
            if writer is not None:
                writer.close()
                fs.move(f"{folder}/.{own}", f"{folder}/{own}")

        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            for p in pc.unique(rows["part"]).to_pylist():  # rows of a part follow one another
                if p != part:
                    end()
                    part, own = p, f"part-{p:08d}-{self.number:06d}-{uuid.uuid4().hex}.parquet"
                    writer = pq.ParquetWriter(f"{folder}/.{own}", rows.schema, filesystem=fs)
                writer.write_table(rows.filter(pc.equal(rows["part"], p)))
            n += rows.num_rows
        end()
        return _Written(n)

    def commit(self, messages: list) -> None:
        pass  # each part was published by its task

    def abort(self, messages: list) -> None:
        pass  # what is published stays: that is what a later run need not ask again


def _folder(path: str, number: int) -> str:
    return f"{path}/{number:08d}"


def state(spark: SparkSession, path: str) -> tuple[int, bool]:
    """(number of the newest batch that was opened, whether it is open); (0, False) before the first."""
    for number in sorted((int(n) for n in files.names(spark, path) if n.isdigit()), reverse=True):
        have = files.names(spark, _folder(path, number))
        if OPENED in have:
            return number, CLOSED not in have
    return 0, False


def _say(spark: SparkSession, folder: str, name: str, what: dict) -> bool:
    """Publish one small document by a rename; False if another run came first."""
    staged = f"{folder}/.{name}-{uuid.uuid4().hex}"
    files.put(spark, staged, json.dumps(what, sort_keys=True).encode())
    return files.rename_new(spark, staged, f"{folder}/{name}")


def _said(spark: SparkSession, folder: str, name: str) -> dict:
    return json.loads(files.get(spark, f"{folder}/{name}"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, text, source, facts_hash, batch): every text after the last closed batch."""
    number, is_open = state(spark, path)
    number -= is_open
    if not number:
        return spark.createDataFrame([], STORED)
    folder = _folder(path, number)
    return spark.read.schema(STORED).parquet(f"{folder}/{_said(spark, folder, CLOSED)['stored']}")


def plan(spark: SparkSession, path: str, records: DataFrame, rows_per_part: int = 1_000) -> int:
    """The open batch's number, after opening one for the records (station_id, facts_hash, record) that are new or changed; 0 if there are none.

    Requests are numbered in the order of their stations, ``rows_per_part`` to a part; null ids cannot be asked for and are left out.
    """
    number, is_open = state(spark, path)
    if is_open:
        return number
    records = records.select(F.col("station_id").cast("string").alias("station_id"), "facts_hash", "record").filter("station_id IS NOT NULL")
    todo = ordered(facts_of.changed_only(records, stored(spark, path)), ["station_id"], number="_place")
    folder, own = _folder(path, number + 1), f"requests-{uuid.uuid4().hex}"
    place = F.col("_place") - 1
    custom = F.concat(F.lit("s"), F.lpad(place.cast("string"), F.greatest(F.length(place.cast("string")), F.lit(5)), F.lit("0")))
    todo.select(F.floor(place / rows_per_part).cast("int").alias("part"), custom.alias("custom_id"), "station_id", "facts_hash", "record").write.parquet(f"{folder}/{own}")
    last = spark.read.parquet(f"{folder}/{own}").agg(F.max("part").alias("last")).first().last
    if last is None:
        files.delete(spark, f"{folder}/{own}")
        return 0
    files.make(spark, f"{folder}/results")
    _say(spark, folder, OPENED, {"requests": own, "n_parts": last + 1})  # of two runs the first one's plan holds
    return number + 1


def requests(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(part, custom_id, station_id, facts_hash, record) of a batch."""
    folder = _folder(path, number)
    return spark.read.parquet(f"{folder}/{_said(spark, folder, OPENED)['requests']}")


def results(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(custom_id, text, source): the earliest answer for each id that has one."""
    rows = spark.read.schema(RESULT).parquet(f"{_folder(path, number)}/results")
    first = rows.select("custom_id", F.struct(F.regexp_extract("_metadata.file_name", r"-(\d+)-\w+\.parquet$", 1).alias("round"), "text", "source").alias("a")).groupBy("custom_id").agg(F.min("a").alias("a"))
    return first.select("custom_id", "a.text", "a.source")


def pending(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The requests of a batch that have no answer yet."""
    return requests(spark, path, number).join(results(spark, path, number).select("custom_id"), "custom_id", "left_anti")


def work(spark: SparkSession, path: str, answer: Callable[[DataFrame], DataFrame]) -> int:
    """Answer what the open batch still waits for; returns how many requests are left then.

    ``answer`` takes requests and returns part, custom_id, text, source.  It works row by row or partition by partition (columns, ``mapInPandas``): a shuffle inside would
    hold every answer back until all are there.  A part lies whole in one partition; a partition has the parts that follow one another, some
    ``PARTS_AT_ONCE`` partitions a core at most, since each is a task and a Python worker's start.
    """
    number, is_open = state(spark, path)
    if not is_open:
        return 0
    prepare_workers(spark)
    spark.dataSource.register(Results)
    folder = _folder(path, number)
    before = [int(n.split("-")[2]) for n in files.names(spark, f"{folder}/results") if n.startswith("part-")]
    parts = _said(spark, folder, OPENED)["n_parts"]
    tasks = min(parts, PARTS_AT_ONCE * spark.sparkContext.defaultParallelism)
    todo = pending(spark, path, number).repartitionById(tasks, F.floor(F.col("part").cast("long") * tasks / parts).cast("int")).sortWithinPartitions("part")
    answered = answer(todo).filter("text IS NOT NULL").selectExpr("CAST(part AS INT) AS part", "custom_id", "text", "source")
    answered.write.format("batch_results").mode("append").option("folder", files.as_uri(f"{folder}/results")).option("round", max(before, default=0) + 1).save()
    return pending(spark, path, number).count()


def close(spark: SparkSession, path: str, records: DataFrame) -> int:
    """Close the open batch: its texts, and the unchanged ones of before, of the stations in ``records``.  Raises while requests are left."""
    number, is_open = state(spark, path)
    if not is_open:
        return number
    if left := pending(spark, path, number).count():
        raise RuntimeError(f"batch {number} waits for {left} answers")
    folder, own = _folder(path, number), f"stored-{uuid.uuid4().hex}"
    asked = requests(spark, path, number)
    new = asked.join(results(spark, path, number), "custom_id").select("station_id", "text", "source", "facts_hash", F.lit(number).cast("long").alias("batch"))
    kept = stored(spark, path).join(asked.select("station_id"), "station_id", "left_anti")
    here = records.select(F.col("station_id").cast("string").alias("station_id")).distinct()
    new.unionByName(kept).join(here, "station_id", "left_semi").write.parquet(f"{folder}/{own}")
    _say(spark, folder, CLOSED, {"stored": own})
    return number


def run(spark: SparkSession, path: str, records: DataFrame, answers: list[Callable[[DataFrame], DataFrame]], rows_per_part: int = 1_000) -> DataFrame:
    """Take up the open batch or open one, ask ``answers`` in turns (the next one for what the ones before left), close it; the stored texts."""
    if plan(spark, path, records, rows_per_part):
        for answer in answers:
            if not work(spark, path, answer):
                break
        close(spark, path, records)
    return stored(spark, path)


def summary(texts: DataFrame) -> DataFrame:
    """(source, n): how the stored texts came about."""
    return texts.groupBy("source").agg(F.count("*").alias("n"))
