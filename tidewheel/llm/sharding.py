"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 in the order of (doc_id, text hash), the numbers are permuted by a
keyed bijection, and row ``p`` goes to slot ``p div shards`` of shard ``p mod shards``.  Shard sizes
differ by one row at most, slots are gapless, and place and number give each other without a
table.  Texts stay where they are read: only (doc_id, size, crc, hash) is sorted.

Rows with equal ids, or equal rows, take consecutive numbers.  Null texts have size 16 and the
crc of no bytes; null ids come first.  An empty table gives no rows.  Other columns are ignored.
"""
from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.llm import shared

ROUNDS = 6
WALKS = 64


def _step(x: Column, a: int, b: int, seed: int) -> Column:
    """A Feistel network on pairs (x div b, x mod b): each round adds a keyed hash of one half to the other."""
    left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b))
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed + i)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed + i)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permute(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` in a permutation of 0..n-1.

    The network acts on a * b >= n values, fewer than sqrt(n) + 1 of them beyond n - 1; such a
    value walks on through the network until it lands below n.
    """
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    walk = lambda v: F.when(v < F.lit(n), v).otherwise(_step(v, a, b, seed))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _step(number, a, b, seed), lambda v, _: walk(v))


def number_rows(df: DataFrame, *order: str, to: str = "row_number", partitions: int | None = None) -> tuple[DataFrame, int]:
    """(``df`` with global row numbers from 0 in the given order, number of rows).

    A range sort numbers rows within partitions; the sorted table is written to the shared
    folder, and one count per partition, summed up, gives where each partition starts.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = shared.materialise(rows.withColumn("_part", F.shiftright("_at", 33).cast("int")), "numbered")
    starts, total = [], 0
    for r in sorted(rows.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r._part):
        starts.append((r._part, total))  # one row per partition
        total += r.n
    if not starts:
        return rows.withColumn(to, F.lit(0).cast("long")).drop("_at", "_part"), 0
    base = df.sparkSession.createDataFrame(starts, "_part int, _base long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(F.broadcast(base), "_part").withColumn(to, F.col("_base") + inside)
    return out.drop("_at", "_part", "_base"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 2024) -> DataFrame:
    """Every row's shard and slot under the ``rows`` law."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64("text").alias("_tie"),
    )
    rows, n = number_rows(narrow, "doc_id", "_tie")
    rows = rows.withColumn("place", permute(F.col("row_number"), n, seed))
    rows = rows.withColumn("place", F.when(F.col("place") < n, F.col("place")).otherwise(F.raise_error(F.lit("the walk did not end"))))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
