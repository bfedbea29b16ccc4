"""Landing files from executors: named files, ranged downloads, verified pages; the driver handles names and sizes, never content.

Both writers stage what a task fetched or was given under names of its own in one hidden folder of the job.  Only when every task is
through does the commit move the staged files to their names; on an abort, and after a commit, the hidden folder goes, and with it
whatever killed attempts left.  Workers reach the folder through Arrow's file systems (local, HDFS, object stores).
"""
from __future__ import annotations

import json
import re
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidewheel.session import prepare_workers
from tidewheel.sources import files

PIECE = 1 << 20
BLOCK = 64 << 20


def arrow_fs(uri: str):
    """(Arrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def fetch(url: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Bytes [start, end) of a URL in pieces (all of it without ``end``); raises if there are fewer.

    A server that answers a range with the whole file is read up to the end and cut.
    """
    want, skip = None if end is None else end - start, 0
    if url.startswith(("http:", "https:")):
        stream = urllib.request.urlopen(urllib.request.Request(url, headers={} if end is None else {"Range": f"bytes={start}-{end - 1}"}), timeout=60)
        if end is not None and stream.status != 206:
            skip = start
    else:
        fs, path = arrow_fs(url)
        stream = fs.open_input_file(path)
        stream.seek(start)
    got = 0
    with stream:
        while skip > 0:
            lost = len(stream.read(min(PIECE, skip)))
            if not lost:
                break
            skip -= lost
        while want is None or got < want:
            piece = stream.read(PIECE if want is None else min(PIECE, want - got))
            if not piece:
                break
            got += len(piece)
            yield piece
    if want is not None and got != want:
        raise OSError(f"{url}: {got} bytes of {want} from {start}")


def size_of(url: str) -> int | None:
    """A URL's length, asked for without its content; None if it is not told."""
    if url.startswith(("http:", "https:")):
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
            n = r.headers.get("Content-Length")
            return None if n is None else int(n)
    fs, path = arrow_fs(url)
    info = fs.get_file_info(path)
    if not info.is_file:
        raise FileNotFoundError(url)
    return info.size


@dataclass
class _Staged(WriterCommitMessage):
    files: list


class NamedFiles(DataSource):
    """Sink of rows (name string, content binary) or (name string, url string, start long, end long): a file per name below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["path"], self.options["job"], [f.name for f in schema.fields])


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, job: str, columns: list[str]):
        self.path, self.staging, self.columns = path.rstrip("/"), f"{path.rstrip('/')}/.staged-{job}", columns

    def write(self, iterator: Iterator[T.Row]) -> _Staged:
        out = []
        fs, staging = arrow_fs(self.staging)  # made by the driver: once it is gone, tasks that still run write nothing more
        for row in iterator:
            r = dict(zip(self.columns, row))
            own, n = f"{staging}/{uuid.uuid4().hex}", 0
            with fs.open_output_stream(own) as f:
                for piece in [bytes(r["content"])] if "content" in r else fetch(r["url"], r["start"], r["end"]):
                    f.write(piece)
                    n += len(piece)
            out.append((own, r["name"], n))
        return _Staged(out)

    def commit(self, messages: list) -> None:
        fs, to = arrow_fs(self.path)
        for m in messages:
            for own, name, _ in m.files if m else []:
                fs.create_dir(f"{to}/{name}".rsplit("/", 1)[0], recursive=True)
                fs.move(own, f"{to}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, staging = arrow_fs(self.staging)
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)


def _write(rows: DataFrame, folder: str) -> None:
    spark = rows.sparkSession
    prepare_workers(spark)
    spark.dataSource.register(NamedFiles)
    job = uuid.uuid4().hex
    files.make(spark, f"{folder}/.staged-{job}")
    rows.write.format("named_files").mode("append").option("path", folder).option("job", job).save()


def write_files(rows: DataFrame, folder: str) -> str:
    """Write each row (name, content: text or bytes) as a file of that name below ``folder``, on the executors; returns the folder's URI.

    All files appear once all are written.  Of equal names the last moved stays; a null content is an empty file.
    """
    folder = files.as_uri(folder)
    _write(rows.select("name", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")), folder)
    return folder


def land(spark: SparkSession, urls: list[tuple[str, str]], folder: str, block: int = BLOCK) -> DataFrame:
    """Files of (url, name) below ``folder``: (name, bytes, fetched); one that is there already is not fetched again.

    Lengths are asked for on executors, then every range of ``block`` bytes is a task of its own; ranges of a file are put together by one
    task and the whole appears under its name by a rename.  A URL without a told length is one task.  A range that comes short fails the job, which leaves nothing.
    """
    prepare_workers(spark)
    folder = files.as_uri(folder)
    todo = [(u, n) for u, n in dict((n, (u, n)) for u, n in urls).values() if not files.exists(spark, f"{folder}/{n}")]
    landed: dict[str, bool] = {n: False for _, n in urls}

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "name": pdf["name"], "size": pd.array([size_of(u) for u in pdf["url"]], dtype="Int64")})

    if todo:
        asked = spark.createDataFrame(todo, "url string, name string").repartition(min(len(todo), 64)).mapInPandas(ask, "url string, name string, size long")
        sizes = asked.collect()  # a row for each file
        parts, whole = [], []
        for r in sizes:
            if r["size"] is None or r["size"] <= block:
                whole.append((r["name"], r["url"], 0, r["size"]))
            else:
                parts += [(f"{r['name']}.parts/{i:012d}", r["url"], s, min(s + block, r["size"])) for i, s in enumerate(range(0, r["size"], block))]
        if parts or whole:
            rows = spark.createDataFrame(whole + parts, "name string, url string, start long, end long")
            _write(rows.repartition(min(len(whole) + len(parts), 1024), "name"), folder)
        several = sorted({n.split(".parts/")[0] for n, *_ in parts})
        if several:
            _assemble(spark, several, folder)
        landed |= {n: True for _, n in todo}
    found = [(n, fetched, files.length(spark, f"{folder}/{n}")) for n, fetched in sorted(landed.items())]
    return spark.createDataFrame([(n, size, f) for n, f, size in found], "name string, bytes long, fetched boolean")


def _assemble(spark: SparkSession, names: list[str], folder: str) -> None:
    def join(batches):
        for pdf in batches:
            for name in pdf["name"]:
                from pyarrow import fs as pfs

                fs, base = arrow_fs(folder)
                parts = sorted(f.path for f in fs.get_file_info(pfs.FileSelector(f"{base}/{name}.parts")) if f.is_file)
                own = f"{base}/.joined-{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    for p in parts:
                        with fs.open_input_stream(p) as f:
                            while piece := f.read(PIECE):
                                out.write(piece)
                fs.move(own, f"{base}/{name}")
            yield pdf

    spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names), "name").mapInPandas(join, "name string").write.format("noop").mode("overwrite").save()
    for n in names:
        files.delete(spark, f"{folder}/{n}.parts")
    for left in files.names(spark, folder):
        if left.startswith(".joined-"):  # of attempts that were lost
            files.delete(spark, f"{folder}/{left}")


def land_paged(spark: SparkSession, url: str, count_url: str, columns: list[str], path: str, page: int = 1000) -> DataFrame:
    """All rows of a paged endpoint as a Parquet table at ``path``, each page fetched once by a task of its own.

    The server is asked for its count first (``count_url``: a JSON list of one object with ``count``); the rows are counted while they are written, and
    another number raises ``ValueError`` and leaves nothing.  A table that is there is read, nothing is fetched.
    """
    path = files.as_uri(path)
    if not files.exists(spark, f"{path}/_SUCCESS"):
        count = int(json.loads(b"".join(fetch(count_url)))[0]["count"])
        seen, staged = Observation(), f"{path}.staged-{uuid.uuid4().hex}"
        rows = files.paged(spark, url, count, columns, page)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staged)
        got = seen.get["n"]
        if got != count:
            files.delete(spark, staged)
            raise ValueError(f"expected {count} rows, got {got}")
        files.delete(spark, path)
        files.rename_new(spark, staged, path)
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).parquet(path)
