"""Packing: first-fit decreasing over a tournament tree, run in randomised groups of documents.

A document's ids (with its end id) are cut into as many full sequences as it fills; the
remainder is an item.  Items meet in groups drawn by a hash of document id and row position,
so neither a hot source nor one repeated id can make a group large.  Within a group, items go
largest first into the leftmost open sequence with room, found in O(log n) by descending a
tree that holds the most room below each node.  Only piece descriptors are shuffled, never
texts or ids.  A sequence whose filled length is a power of two needs no padding.

Null texts count as empty (one id, the end id).  Repeated rows are packed as often as they
stand.  An empty table gives no rows.  Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import bpe, shared, text as tx

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item; larger items first, equal ones in the order given."""
    n = len(sizes)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], at[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a > b else b
            if room[node] == most:
                break
            room[node] = most
    return bins, at


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """One row per piece: full sequences, then the remainder; ``salt`` spreads repeated ids."""
    shared.prepare(docs.sparkSession)

    def cut(batches):
        enc, seen = bpe.encoder(tokenizer), 0
        for batch in batches:
            ids_of = batch.column(0)
            for i, j, raw, offs in tx.chunks(batch.column(1)):
                ids, at = enc.encode(raw, offs)
                ids, at = ids.astype("<u4"), at.tolist()
                rows = []
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    total = len(own) // 4
                    for s in range(0, total, length):
                        part = own[4 * s : 4 * (s + length)]
                        rows.append((k, s, len(part) // 4, zlib.crc32(part), total, seen + k))
                seen += j - i
                cols = np.array(rows, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(cols[:, 0] + i)), *(pa.array(cols[:, c]) for c in range(1, 6))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, group_docs: int = 2048, seed: int = 17) -> DataFrame:
    """Pieces of ``docs`` with the sequence and the offset in it where each one goes.

    ``group_docs`` bounds, on average, the documents that one task packs together.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer, length, end_id)
    drawn = F.pmod(F.xxhash64("doc_id", "salt", F.lit(seed)), F.lit(groups))

    def fill(key, frame):
        frame = frame.sort_values(["doc_id", "start", "length", "salt"], kind="stable", na_position="first")
        sizes = frame["length"].to_numpy()
        full = sizes == length
        number, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        number[full] = np.arange(full.sum())
        bins, at = first_fit_decreasing(sizes[~full], length)
        number[~full], offset[~full] = full.sum() + bins, at
        return frame.drop(columns=["salt", "box"]).assign(sequence_id=int(key[0]) * (1 << 32) + number, offset=offset)

    return cut.withColumn("box", drawn).groupBy("box").applyInPandas(fill, PACKED)
