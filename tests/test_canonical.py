"""Canonical JSON against the standard library's sorted compact dump."""
import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from tidewheel.functions import canonical as cn
from tidewheel.operators import facts


def dump(v):
    return json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_numbers(spark):
    r = random.Random(9)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1 / 3, 100.0, 123456.789, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, 1e23, 1e-4, 1e-5, 0.00012345, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2e-3, 0.3, 2.5, 1e100, 9007199254740993.0, float("nan"), float("inf"), float("-inf"), 12.0, 120.0, 1e21, 2.0**70]
    values += [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)] + [round(r.uniform(-1e4, 1e4), r.randrange(6)) for _ in range(2000)]
    values = [v for v in values if not math.isnan(v)] + [float("nan")]
    got = [x.t for x in spark.createDataFrame([(v,) for v in values], "v double").select(cn.number(F.col("v")).alias("t")).collect()]
    wrong = [(v, json.dumps(v), t) for v, t in zip(values, got) if t != json.dumps(v)]
    assert not wrong, wrong[:5]


def test_text(spark):
    values = ["", "plain", 'quote " and \\ back', "tab\t nl\n cr\r bs\b ff\f", "".join(map(chr, range(32))), "é 日本 \U0001f6b2", "\x7f ", "{\"a\":1}"]
    got = [x.t for x in spark.createDataFrame([(v,) for v in values], "v string").select(cn.quoted(F.col("v")).alias("t")).collect()]
    assert got == [dump(v) for v in values]


RECORDS = [
    {"b": 1, "a": {"z": None, "é": "ü", "B": [1.5, None, 2.0]}, "m": {"k2": {"y": 1, "x": True}, "k1": None, "K": {"y": None, "x": False}}, "list": [{"q": "1", "p": None}, None]},
    {"b": None, "a": None, "m": {}, "list": []},
    {"b": -7, "a": {"z": 10**12, "é": None, "B": []}, "m": None, "list": None},
]
SCHEMA = "b int, a struct<z: long, `é`: string, B: array<double>>, m map<string, struct<y: int, x: boolean>>, list array<struct<q: string, p: string>>"
TURNED = "list array<struct<p: string, q: string>>, m map<string, struct<x: boolean, y: int>>, a struct<B: array<double>, `é`: string, z: long>, b int"


def test_records_whatever_the_order_of_keys(spark):
    want = [dump(r) for r in RECORDS]
    for schema in (SCHEMA, TURNED):
        df = spark.createDataFrame([json.dumps(r) for r in RECORDS], "string").select(F.from_json("value", schema).alias("r")).select("r.*")
        assert [x.t for x in df.select(cn.record(df, df.columns).alias("t")).collect()] == want
        hashes = [x.facts_hash for x in facts.facts_hash(df.withColumn("station_id", F.lit("s")), df.columns).collect()]
        assert hashes == [hashlib.sha256(t.encode()).hexdigest() for t in want]
        plan = df.select(cn.record_hash(df, df.columns))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_a_moved_key_sends_nothing_again(spark):
    old = spark.createDataFrame([json.dumps(r) for r in RECORDS], "string").select(F.from_json("value", SCHEMA).alias("r")).select(F.monotonically_increasing_id().cast("string").alias("station_id"), "r.*")
    new = spark.createDataFrame([json.dumps(r) for r in RECORDS], "string").select(F.from_json("value", TURNED).alias("r")).select(F.monotonically_increasing_id().cast("string").alias("station_id"), "r.*")
    hashed = lambda df: facts.facts_hash(df, [c for c in df.columns if c != "station_id"])
    assert facts.changed_only(hashed(new), hashed(old)).collect() == []
    other = new.withColumn("b", F.when(F.col("b") == 1, 2).otherwise(F.col("b")))
    assert facts.changed_only(hashed(other), hashed(old)).count() == 1
