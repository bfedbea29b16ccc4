"""Token-id files: a concatenated id array with Elias-Fano coded document borders.

One file, ``ids-NNNNN.efids``, per range of document ids:

    8 bytes    magic ``EFIDS\\x01`` and the id width in bytes (2 or 4), one zero
    ids        little-endian, all documents one after another
    borders    Elias-Fano of each document's end
    doc ids    Elias-Fano of the ids less the smallest (null ids come first and are not in it)
    40 bytes   start and size of borders, size of doc ids, smallest id, number of null ids

Writers work on Spark's own range partitions, stream ids to a temporary name and move it into
place, so a lost or repeated task leaves one whole file.  Files go through
``pyarrow.fs`` (local paths, s3, gs, hdfs), below a folder that driver and executors share.

Null texts count as empty; equal ids stand next to each other in the order of their texts'
hashes; an empty table gives no files and no rows; other columns are ignored.
"""
from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewheel.llm import bpe, shared, text as tx
from tidewheel.llm.elias_fano import EliasFano

MAGIC = b"EFIDS\x01"
_TAIL = "<QQQqQ"
MANIFEST = "part int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
IDS_AT_ONCE = 1 << 20  # read at once, or one document


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, partitions: int | None = None, width: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files below ``out``; returns the manifest.

    ``width``: bytes an id, by default 2 where the tokenizer's ids fit.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = cols.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches):
        enc, part = bpe.encoder(tokenizer), TaskContext.get().partitionId()
        size = width or (2 if enc.whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4)
        fs, root = _open(out)
        stream = None
        ends: list[np.ndarray] = []
        names: list[np.ndarray] = []
        nulls = total = 0
        for batch in batches:
            if stream is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                temp = f"{root}/.{uuid.uuid4().hex}"
                stream = fs.open_output_stream(temp)
                stream.write(MAGIC + bytes([size, 0]))
            nulls += batch.column(0).null_count
            names.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            for _, _, raw, offs in tx.chunks(batch.column(1)):
                ids, at = enc.encode(raw, offs)
                ids = np.insert(ids, at[1:], end_id)
                stop = at[1:] + np.arange(1, len(at))
                stream.write(ids.astype(f"<u{size}").tobytes())
                ends.append(total + stop)
                total += len(ids)
        if stream is None:
            return
        borders = EliasFano.encode(np.concatenate(ends), total + 1).to_bytes()
        who = np.concatenate(names).astype(np.int64)
        least = int(who[0]) if len(who) else 0
        named = EliasFano.encode(who - least).to_bytes()
        stream.write(borders + named + struct.pack(_TAIL, 8 + total * size, len(borders), len(named), least, nulls))
        stream.close()
        final = f"{root}/ids-{part:05d}.efids"
        fs.move(temp, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{out}/ids-{part:05d}.efids"]), pa.array([sum(map(len, ends))]), pa.array([total])],
            names=["part", "path", "n_docs", "n_ids"],
        )

    return shared.materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


class TokenFile:
    """Reads one file: any document's ids by two selects, without a table of offsets."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(8, 0)
        if head[:6] != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        self.width = head[6]
        at, borders, named, self.least, self.nulls = struct.unpack(_TAIL, self.file.read_at(struct.calcsize(_TAIL), size - struct.calcsize(_TAIL)))
        self.borders = EliasFano.from_bytes(self.file.read_at(borders, at))
        self.named = EliasFano.from_bytes(self.file.read_at(named, at + borders))

    def __len__(self) -> int:
        return self.borders.n

    def ends(self, i: int, j: int) -> np.ndarray:
        """The start of document i and the ends of documents i to j - 1."""
        first = self.borders.select(i - 1) if i else np.zeros(1, np.int64)
        return np.concatenate([first, self.borders.select(np.arange(i, j))])

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        known = self.named.select(np.arange(max(i - self.nulls, 0), max(j - self.nulls, 0))) + self.least
        return [None] * max(0, min(j, self.nulls) - i) + known.tolist()

    def blocks(self, most_ids: int) -> list[tuple[int, int]]:
        """Ranges of documents of at most ``most_ids`` ids each, or of one document."""
        out, i, n = [], 0, len(self)
        while i < n:
            j, step = i + 1, 1
            start = int(self.ends(i, i)[0])
            while j < n and step:  # widen by doubling steps, then by halves
                if int(self.borders.select(min(j + step, n) - 1)[0]) - start <= most_ids:
                    j = min(j + step, n)
                    step *= 2
                else:
                    step //= 2
            out.append((i, j))
            i = j
        return out

    def ids(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.width, 8 + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        a, b = self.ends(i, i + 1)
        return self.ids(int(a), int(b))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document read back from the files: where it starts among all ids, its length and crc.

    The driver holds one manifest row per file, as many as there were range partitions.
    """
    shared.prepare(spark)
    files, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((r.path, base))
        base += r.n_ids
    if not files:
        return spark.createDataFrame([], ROWS)

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path)
                for i, j in f.blocks(IDS_AT_ONCE):
                    at = f.ends(i, j)
                    ids = f.ids(int(at[0]), int(at[-1])).astype("<u4")
                    cut = (at - at[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids(i, j), pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    jobs = spark.createDataFrame(files, "path string, base long").repartition(len(files))
    return jobs.mapInArrow(read, ROWS)
