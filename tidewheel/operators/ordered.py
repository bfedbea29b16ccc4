"""Ordered passes without one task for everything: row numbers, running sums, next values, exact quantiles.

Rows are dealt to ranges of the order and sorted there; numbers, sums and next values are found inside a range first.
Then what each range passes on (its count, its sums, its first row: one row a range) is added up at the driver and joined
back.  A range is a task; equal keys share one, so aggregate rows by key first where keys repeat.

Quantiles are selected: a mergeable sketch brackets the wanted rank, rows below are only counted, and the few in the bracket are
ordered.  The result is the exact interpolated quantile, as a sort of everything would give it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidewheel.functions import scalars as S
from tidewheel.session import cut

ACCURACY = 10_000


def ordered(df: DataFrame, order: list, number: str | None = None, sums: dict[str, str] | None = None, nexts: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with, in ``order``: ``number`` (from 1), running sums up to and with the row (``sums``: name -> column, null counts as nothing) and the
    next row's values (``nexts``: name -> column, null in the last row).

    Rows that are equal in ``order`` are taken in any order.  ``df`` is computed once and kept in the checkpoint folder; the driver holds a row a range.
    """
    sums, nexts, spark = sums or {}, nexts or {}, df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [S.col(c) for c in order]
    inside = W.partitionBy("_range").orderBy(*own)
    rows = df.repartitionByRange(n, *own).withColumn("_range", F.spark_partition_id())
    found = {"_number": F.row_number().over(inside).cast("long")}
    found |= {f"_sum_{i}": F.coalesce(F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) for i, c in enumerate(sums.values())}
    if nexts:
        found["_next"] = F.lead(F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(nexts.values())])).over(inside)
    rows = cut(rows.withColumns(found))
    edge = [F.count("*").alias("rows"), *[F.max_by(f"_sum_{i}", "_number").alias(f"s{i}") for i in range(len(sums))]]
    if nexts:
        edge.append(F.min_by(F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(nexts.values())]), "_number").alias("first"))
    edges = rows.groupBy("_range").agg(*edge).orderBy("_range").collect()  # a row for each range
    carries, seen, total = [], 0, [None] * len(sums)
    for k, e in enumerate(edges):
        carries.append((e["_range"], seen, *total, edges[k + 1]["first"] if nexts and k + 1 < len(edges) else None))
        seen += e["rows"]
        total = [e[f"s{i}"] if t is None else t + e[f"s{i}"] for i, t in enumerate(total)]
    fields = [T.StructField("_range", T.IntegerType()), T.StructField("_before", T.LongType())]
    fields += [T.StructField(f"_before_{i}", rows.schema[f"_sum_{i}"].dataType) for i in range(len(sums))]
    fields.append(T.StructField("_follows", rows.schema["_next"].dataType if nexts else T.StringType()))
    out = rows.join(F.broadcast(spark.createDataFrame(carries, T.StructType(fields))), "_range")  # a row for each range
    added: dict[str, Column] = {number: F.col("_number") + F.col("_before")} if number else {}
    added |= {name: F.col(f"_sum_{i}") + F.coalesce(f"_before_{i}", F.lit(0)) for i, name in enumerate(sums)}
    if nexts:
        added |= {name: F.coalesce("_next", "_follows")[f"n{i}"] for i, name in enumerate(nexts)}
    return out.withColumns(added).select(*df.columns, *[c for c in added if c not in df.columns])


def quantile(df: DataFrame, column, q: float, keys: list[str] | None = None, name: str = "quantile", accuracy: int = ACCURACY) -> DataFrame:
    """Exact interpolated quantile ``q`` of ``column`` (nulls left out) for each group of ``keys``, or one row without keys (null if no value).

    Three aggregations: a sketch of two percentiles around the rank (off by at most 1 / ``accuracy`` of the rows, so the bracket of
    four times that holds it), counts below the bracket, and the bracket's distinct values with their counts, which alone are ordered:
    in ranges without keys, within a group with keys.
    """
    keys = keys or []
    rows = df.select(*keys, S.col(column).cast("double").alias("_v")).filter("_v IS NOT NULL")
    margin = 4 / accuracy
    ends = F.percentile_approx("_v", [max(0.0, q - margin), min(1.0, q + margin)], accuracy)
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), ends.alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # the ends of the order are known, not estimated
    low = F.lit(q <= margin) | (F.col("_n") <= accuracy)
    high = F.lit(q >= 1 - margin) | (F.col("_n") <= accuracy)
    sketch = cut(sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.when(low, F.col("_min")).otherwise(F.col("_e")[0]).alias("_low"), F.when(high, F.col("_max")).otherwise(F.col("_e")[1]).alias("_high")))

    def beside(frame: DataFrame) -> DataFrame:
        """With its group's sketch (null keys are a group); without keys the sketch is one row."""
        if not keys:
            return frame.join(F.broadcast(sketch))
        on = [frame[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return frame.join(sketch, on).drop(*[f"_k{i}" for i in range(len(keys))])

    near = beside(rows)
    spot = F.when(F.col("_v") < F.col("_low"), F.lit(None)).otherwise(F.col("_v"))
    # rows below the bracket are one value (null), sorted before the others
    counts = near.filter(F.col("_v") <= F.col("_high")).groupBy(*keys, spot.alias("_v")).agg(F.count("*").alias("_c"))
    if keys:
        upto = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_v"))))
    else:
        upto = ordered(counts, [F.asc_nulls_first("_v")], sums={"_upto": "_c"})
    upto = beside(upto)
    rank = F.lit(q) * (F.col("_n") - 1)
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.struct("_upto", "_v")))["_v"]
    found = upto.groupBy(*keys).agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_b"), F.first("_n").alias("_n"))
    part = F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1))
    value = F.when(F.col("_n").isNull(), F.lit(None).cast("double")).when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the sketch missed the rank")).cast("double")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * part)
    return found.select(*keys, value.alias(name))
