"""Figures, rules and plain texts as column expressions, held against plain Python that reads one text at a time."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tests import plain_briefs as plain
from tidewheel.functions import briefs, figures

SCHEMA = """name string, typology string, typology_matches_peak boolean, weekend_differs boolean,
    weekday_flow struct<low_signal: boolean, fill_peak_hour: string, fill_bikes_per_day: double, drain_peak_hour: string, drain_bikes_per_day: double>,
    weekend_flow struct<low_signal: boolean, fill_peak_hour: string, drain_peak_hour: string>,
    reliability struct<status: string, unusable_pct: double, rank: int, n_ranked: long, system_unusable_pct: double>,
    context struct<nearest_subway: string, subway_distance_m: int, near_nycha: boolean, nycha_name: string, near_school: boolean, school_name: string, transit_gap: boolean, nycha_threshold_m: int, school_threshold_m: int, transit_gap_threshold_m: int>"""


def _record(**more):
    r = {"name": "W 59 St & 4 Ave", "typology": "Commuter core (fills AM, drains PM)", "typology_matches_peak": True,
         "weekday_flow": {"low_signal": False, "fill_peak_hour": "8 AM", "fill_bikes_per_day": 2.1, "drain_peak_hour": "5 PM", "drain_bikes_per_day": 1.0},
         "weekend_flow": {"low_signal": True}, "weekend_differs": False,
         "reliability": {"status": "ok", "unusable_pct": 13.0, "rank": 22, "n_ranked": 2507, "system_unusable_pct": 12.5},
         "context": {"nearest_subway": "14 St", "subway_distance_m": 350, "near_nycha": False, "nycha_name": None, "near_school": True, "school_name": "P.S. 184m Shuang Wen", "transit_gap": False,
                     "nycha_threshold_m": 300, "school_threshold_m": 300, "transit_gap_threshold_m": 800}}
    return r | more


MORE = [{}, {"typology_matches_peak": False}, {"typology_matches_peak": None}, {"weekend_differs": True, "weekend_flow": {"low_signal": False, "fill_peak_hour": "1 PM", "drain_peak_hour": None}},
        {"weekday_flow": {"low_signal": True}}, {"reliability": {"status": "no_data"}}, {"reliability": {"status": "not_rankable"}}, {"typology": "Mixed/flat rhythm"},
        {"context": _record()["context"] | {"transit_gap": True, "near_nycha": True, "nycha_name": "Mt. Olive Av. Houses", "subway_distance_m": 1350}}]


def _frame(spark, pairs):
    """(n, text, r) of texts and records."""
    rows = [(n, t, json.dumps(r)) for n, (t, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "n int, text string, r string").withColumn("r", F.from_json("r", SCHEMA))


def _checked(spark, pairs):
    df = _frame(spark, pairs)
    got = df.select("n", briefs.violations(F.col("text"), F.col("r"), df.schema["r"].dataType).alias("v"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return [r.v for r in got.orderBy("n").collect()]


def test_plain_texts_keep_every_rule(spark):
    records = [_record(**m) for m in MORE]
    df = _frame(spark, [(None, r) for r in records])
    texts = [r.t for r in df.orderBy("n").select(briefs.plain_text(F.col("r"), df.schema["r"].dataType).alias("t")).collect()]
    assert texts == [plain.plain_text(r) for r in records]
    assert _checked(spark, list(zip(texts, records))) == [[]] * len(records)


SAID = [
    ("fills most at 8 AM on weekdays.", ""), ("fills most at 5 PM on weekdays.", "peaks"), ("lacks docks in 14.0% of readings.", "numbers"), ("is 22 m away.", "numbers"), ("is 300 metres from P.S. 184m Shuang Wen.", ""),
    ("empties late at night.", "day type"), ("peaks at noon on weekends.", "numbers,weekend"), ("is lower than the system.", "comparison"), ("is higher than the system.", ""), ("empties due to rain.", "style"),
    ("is a commuter-core station.", ""), ("is near Knight Morningside.", ""),
]


def test_rules(spark):
    r = _record()
    got = _checked(spark, [(f"{r['name']} {said}", r) for said, _ in SAID])
    assert [",".join(v.split(":")[0] for v in vs) for vs in got] == [rules for _, rules in SAID]


def test_hedge_in_every_sentence(spark):
    r = _record(typology_matches_peak=False)
    wrong = ("is a commuter-core station.", "is a residential feeder station.", "is grouped with others. It is a commuter core station.")
    *hedged, grouped, named = _checked(spark, [*((f"{r['name']} {said}", r) for said in wrong), (f"{r['name']} is grouped with commuter-core stations.", r), ("W 59 4 Ave is here.", r)])
    assert all(any(v.startswith("hedge") for v in vs) for vs in hedged) and grouped == []
    assert [v.split(":")[0] for v in named] == ["name"]  # its numbers are the name's


PIECES = ["8 AM", "8:00 p.m.", "17 pm", "noon", "Midnight", "13.0%", "12.5 percent", "13", "-4", "2,507", "2,507th", "22nd", "300 m", "350 metres", "3.5 m", "1,350 meters", "14 St", "St. Nicholas", "P.S. 184m Shuang Wen", "Ralph A. Fabrizio",
          "W 59 St & 4 Ave", "twenty", "Second", "one", "weekday", "weekends", "night", "Knight", "rush hour", "because", "due to", "above", "better than", "commuter-core", "grouped with", "A7", "x.5", ".5", "1.2.3", "12,34", "fills most at 8 AM", "drains most at 9 PM",
          "é8 am", "It", "is", "Yes.", "No!", "Why?", "a.m.", "  ", "\n", "\u00a0", "Élan", "$5", "#3rd", "0.0001", "10000000", "8am.", "7 a. m", "(6 PM)"]


def test_random_texts(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(PIECES) + rnd.choice(["", "", ".", ",", "!"]) for _ in range(rnd.randrange(14))) for _ in range(400)] + ["", " ", "x" * 50_000 + " 8 AM. " * 2_000]
    pairs = [(t, _record(**rnd.choice(MORE))) for t in texts]
    df = _frame(spark, pairs)
    rows = df.orderBy("n").select(figures.scan(F.col("text")).alias("k"), figures.sentences(F.col("text")).alias("s")).collect()
    for (t, _), row in zip(pairs, rows):
        assert [(k.kind, k.value if k.said is None else k.said) for k in row.k] == [tuple(k) for k in plain.scan(t)], t[:200]
        assert list(row.s) == plain.sentences(t), t[:200]
    for (t, r), vs in zip(pairs, _checked(spark, pairs)):
        assert vs == plain.violations(t, r), (t[:300], vs, plain.violations(t, r))


def test_nulls_and_names_of_any_kind(spark):
    names = ["a\\E|b (x) night", "[8 AM] *", "", None]
    pairs = [(f"{n or ''} at night.", _record(name=n)) for n in names]
    assert _checked(spark, pairs) == [plain.violations(t, r) for t, r in pairs]
    df = spark.createDataFrame([(None, None)], f"text string, r struct<{SCHEMA.replace(' string,', ': string,', 2).replace('typology_matches_peak boolean, weekend_differs boolean', 'typology_matches_peak: boolean, weekend_differs: boolean').replace('_flow struct', '_flow: struct').replace('reliability struct', 'reliability: struct').replace('context struct', 'context: struct')}>")
    kind = df.schema["r"].dataType
    row = df.select(briefs.violations(F.col("text"), F.col("r"), kind).alias("v"), briefs.plain_text(F.col("r"), kind).alias("t"), figures.vocabulary(F.col("r"), kind).alias("k"), figures.sentences(F.col("text")).alias("s")).first()
    assert (row.v, row.t, row.k, row.s) == ([], None, [], [])


def test_vocabulary_of_nested_records(spark):
    record = {"a_pct": 12.5, "list_m": [300, None, 7], "m": {"x_m": 1.5, "y": 2.0}, "deep": [{"note": "at 8 a.m., 13%"}, None], "flag": True, "d": None}
    kind = "a_pct double, list_m array<int>, m map<string, double>, deep array<struct<note: string>>, flag boolean, d string"
    df = spark.createDataFrame([json.dumps(record)], "string").select(F.from_json("value", kind).alias("r"))
    got = df.select(figures.vocabulary(F.col("r"), df.schema["r"].dataType).alias("k")).first().k
    want = {(k, v) for k, vs in plain.Vocabulary(record).by_kind.items() for v in vs}
    assert {(k.kind, k.said or k.value) for k in got} == want and len(got) == len(want)


def test_rounding_is_that_of_the_binary_value(spark):
    rnd = random.Random(5)
    pairs = [(2.67, 2.675), (2.68, 2.675), (0.12, 0.125), (0.13, 0.125), (2.0, 2.5), (3.0, 2.5), (6.0, 6.3), (6.3, 6.0), (0.5, 0.46), (1e-05, 1e-05), (1234567.9, 1234567.85), (-2.0, -2.5), (0.0, -0.4)]
    for _ in range(3000):
        k = rnd.choice([rnd.uniform(-100, 5000), rnd.randrange(10**6) / 1000, rnd.randrange(10**5) / 16])
        pairs.append((round(k + rnd.choice([0, 0, 10 ** -rnd.randrange(4) / 2]), rnd.randrange(4)), k))
    df = spark.createDataFrame(pairs, "w double, k double").withColumn("n", F.monotonically_increasing_id())
    got = [r.a for r in df.orderBy("n").select(figures.rounds_to(F.col("w"), F.array("k", F.lit(None).cast("double"))).alias("a")).collect()]
    assert got == [plain.rounds_to(w, [k]) for w, k in pairs]


def test_templates(spark):
    df = spark.createDataFrame([("{{y}} $1 \\", None)], "x string, y int")
    values = {"x": F.col("x"), "y": F.col("y")}
    assert df.select(figures.fill_template("{{x}}|{{y}}|{{x}} {z}", values).alias("t")).first().t == "{{y}} $1 \\||{{y}} $1 \\ {z}"
    with pytest.raises(KeyError):
        figures.fill_template("{{x}} {{z}}", values)
