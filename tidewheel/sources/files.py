"""Readers and writers of the mobility feeds: trip archives, logs, JSON documents, paged and per-point APIs."""
from __future__ import annotations

import io
import json
import os
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIP_COLUMNS = ("ride_id rideable_type started_at ended_at start_station_name start_station_id end_station_name end_station_id "
                "start_lat start_lng end_lat end_lng member_casual").split()
TRIP = ", ".join(f"{c} {'double' if c.endswith(('lat', 'lng')) else 'timestamp_ntz' if c.endswith('_at') else 'string'}" for c in TRIP_COLUMNS)
SNAPSHOT = "station_id string, timestamp timestamp, bikes_available int, docks_available int, is_renting int, is_returning int"


def read_trip_csv(spark: SparkSession, path: str) -> DataFrame:
    """Unzipped monthly files; ids stay text."""
    return spark.read.schema(TRIP).csv(path, header=True)


def read_trip_zip(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV member of monthly archives but ``__MACOSX`` ones, in name order, with the archive's name.

    An archive is one task (zip members are not splittable); months run in parallel.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if m.endswith(".csv") and "__MACOSX" not in m):
                        with z.open(member) as f:
                            for part in pd.read_csv(f, dtype=str, chunksize=50_000, keep_default_na=True):
                                yield part.reindex(columns=TRIP_COLUMNS).assign(archive=os.path.basename(name))

    rows = raw.mapInPandas(unpack, ", ".join(f"{c} string" for c in [*TRIP_COLUMNS, "archive"]))
    cast = lambda c: F.col(c).try_cast("double") if c.endswith(("lat", "lng")) else F.col(c).try_cast("timestamp_ntz") if c.endswith("_at") else F.col(c)
    return rows.select(*[cast(c).alias(c) for c in TRIP_COLUMNS], "archive")


def archive_name(month: str) -> str:
    return f"{month.replace('-', '')}-citibike-tripdata.zip"


def _fs(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a URI, in the cluster's or a local one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


file_system = _fs


def get(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes (manifests, feeds' headers)."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, hidden files too; none if it is not there."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def make(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def length(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getLen()


def rename_new(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file to a name that must not be taken: False (and the file deleted) if it is.

    Object stores and HDFS refuse the second of two such renames; a local file system would let it win, so the name is also looked at first.
    """
    fs, p = _fs(spark, path)
    _, t = _fs(spark, to)
    if not fs.exists(t) and fs.rename(p, t):
        return True
    fs.delete(p, False)
    return False


def as_uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else "file://" + os.path.abspath(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def put(spark: SparkSession, path: str, blocks: bytes | Iterator[bytes]) -> None:
    """Write a file, under another name until it is whole."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, path + ".part")
    out = fs.create(part, True)
    for block in [blocks] if isinstance(blocks, bytes) else blocks:
        out.write(bytearray(block))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def rename_all(spark: SparkSession, folder: str, to: str, name: Callable[[int], str]) -> None:
    """The data files of a written folder, moved to names of one's own."""
    fs, p = _fs(spark, folder)
    _, t = _fs(spark, to)
    fs.mkdirs(t)
    found = sorted(str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    for i, f in enumerate(found):
        fs.rename(_fs(spark, f)[1], _fs(spark, f"{to}/{name(i)}")[1])


def partitions(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column, from the folder's names."""
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")]


def delete_raw(paths: list[str], spark: SparkSession | None = None) -> None:
    """Landed archives go once their month is aggregated; one that is gone already is no fault."""
    for p in paths:
        if spark:
            delete(spark, p)
        elif os.path.exists(p):
            os.remove(p)


class _Page(InputPartition):
    def __init__(self, value):
        self.value = value


class PagedSource(DataSource):
    """Offset-paged JSON rows, one partition per page.  Options: url (``{offset}`` and ``{limit}`` in it), count, page, columns."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.options["columns"].split(","))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        size, count = int(self.o.get("page", 1000)), int(self.o["count"])
        return [_Page((i, size)) for i in range(0, count, size)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # no page: Spark asks for one empty partition
            return
        offset, limit = partition.value
        with urllib.request.urlopen(self.o["url"].replace("{offset}", str(offset)).replace("{limit}", str(limit))) as r:
            for row in json.load(r):
                yield tuple(None if row.get(c) is None else row[c] if isinstance(row[c], str) else json.dumps(row[c]) for c in self.o["columns"].split(","))


class WeatherSource(DataSource):
    """Daily weather per point, one partition per point.  Options: url (``{lat}``, ``{lng}``, ``{start}``, ``{end}``), points ("lat:lng,..."), start, end."""

    @classmethod
    def name(cls) -> str:
        return "point_weather"

    def schema(self) -> str:
        return "zone int, date date, temp_mean_c double, precip_mm double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _WeatherReader(self.options)


class _WeatherReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        return [_Page((i, *p.split(":"))) for i, p in enumerate(self.o["points"].split(","))]

    def read(self, partition) -> Iterator[tuple]:
        from datetime import date

        zone, lat, lng = partition.value
        url = self.o["url"]
        for k, v in {"lat": lat, "lng": lng, "start": self.o["start"], "end": self.o["end"]}.items():
            url = url.replace("{" + k + "}", v)
        with urllib.request.urlopen(url) as r:
            d = json.load(r)["daily"]
        for day, t, p in zip(d["time"], d["temperature_2m_mean"], d["precipitation_sum"]):
            yield zone, date.fromisoformat(day), None if t is None else float(t), None if p is None else float(p)


def paged(spark: SparkSession, url: str, count: int, columns: list[str], page: int = 1000) -> DataFrame:
    """Rows of the pages that hold ``count`` rows, a page a task; unchecked (see ``landing.land_paged``)."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(url=url, count=str(count), page=str(page), columns=",".join(columns)).load()


def read_weather(spark: SparkSession, url: str, points: list[tuple[float, float]], start: str, end: str, cache: str | None = None) -> DataFrame:
    """Daily weather of every point; with ``cache`` written once as Parquet by zone and read from there."""
    if cache and exists(spark, f"{cache}/_SUCCESS"):
        return spark.read.parquet(cache)
    spark.dataSource.register(WeatherSource)
    df = spark.read.format("point_weather").options(url=url, points=",".join(f"{a}:{b}" for a, b in points), start=start, end=end).load()
    if not cache:
        return df
    df.write.mode("overwrite").partitionBy("zone").parquet(cache)
    return spark.read.parquet(cache)


def read_snapshot_log(spark: SparkSession, path: str) -> DataFrame:
    """One log file, or the ``snapshots*.csv`` of a folder."""
    reader = spark.read.schema(SNAPSHOT).option("header", True)
    return reader.csv(path) if path.endswith(".csv") else reader.option("pathGlobFilter", "snapshots*.csv").csv(path)


def append_snapshots(df: DataFrame, path: str) -> None:
    """Append readings, one folder per UTC day."""
    df.withColumn("utc_date", F.to_date("timestamp")).write.mode("append").partitionBy("utc_date").option("header", True).csv(path)


def read_feed(spark: SparkSession, status: str, information: str) -> tuple[DataFrame, DataFrame]:
    """Station status (feed_id, readings, timestamp) and information (feed_id, station_id, capacity) from two JSON feeds."""
    s = spark.read.schema("last_updated long, data struct<stations: array<struct<station_id: string, num_bikes_available: int, num_docks_available: int, is_renting: int, is_returning: int>>>").json(status, multiLine=True)
    s = s.select(F.timestamp_seconds("last_updated").alias("timestamp"), F.explode("data.stations").alias("s")).select(
        F.col("s.station_id").alias("feed_id"), "timestamp", F.col("s.num_bikes_available").alias("bikes_available"), F.col("s.num_docks_available").alias("docks_available"), "s.is_renting", "s.is_returning")
    i = spark.read.schema("data struct<stations: array<struct<station_id: string, short_name: string, capacity: int>>>").json(information, multiLine=True)
    i = i.select(F.explode("data.stations").alias("s")).select(F.col("s.station_id").alias("feed_id"), F.col("s.short_name").alias("station_id"), "s.capacity")
    return s, i


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def write_daily(daily: DataFrame, path: str) -> None:
    """The daily table by month; months present in ``daily`` replace theirs, others stay."""
    out = daily.withColumn("month", F.date_format("date", "yyyy-MM"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def station_documents(curves: DataFrame, stations: DataFrame) -> DataFrame:
    """One nested record per station: weekday and weekend curves, and maps of them by season and month."""
    pair = curves.groupBy("station_id", "grain", "period").agg(*[F.max(F.when(F.col("day_type") == d, F.col("curve"))).alias(d) for d in ("weekday", "weekend")])
    zero = F.array_repeat(F.lit(0.0), 24)
    pair = pair.withColumns({d: F.coalesce(d, zero) for d in ("weekday", "weekend")})
    of = lambda g: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("grain") == g, F.struct("period", F.struct("weekday", "weekend"))))))
    all_ = lambda d: F.max(F.when(F.col("grain") == "all", F.col(d)))
    out = pair.groupBy("station_id").agg(all_("weekday").alias("weekday"), all_("weekend").alias("weekend"), of("season").alias("seasons"), of("month").alias("months"))
    return stations.select("station_id", "name", "lat", "lng").join(out, "station_id")


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)

