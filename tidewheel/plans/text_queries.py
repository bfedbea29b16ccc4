"""Queries of figures in texts, what a record allows, sentences and rules; SQL states what each built text must give."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import briefs, figures, scalars as S
from tidewheel.plans.registry import query


def _per_station(x, forms: list[tuple[str, str]], column: str):
    """Every station with every form: (station_id, form, ``column``); a form is a Spark SQL expression over capacity and name."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.expr(e).alias(column)) for f, e in forms]))
    return x.stations.withColumn("e", each).select("station_id", "name", "capacity", "e.form", f"e.{column}")


_FIGURES = [
    ("clock", "concat('Open from ', capacity % 12 + 1, ' am to ', capacity % 12 + 1, ':00 P.M.')"),
    ("noon", "'Closed at noon; full by Midnight'"),
    ("percent", "concat(capacity, '.5% or ', capacity, ' percent')"),
    ("metres", "concat(capacity, ',200 m, ', capacity, 'metres, ', capacity, '.5 m')"),
    ("ordinal", "concat('#', capacity, 'th of 2,507 docks, the third')"),
    ("plain", "concat('-', capacity, ' and twenty')"),
    ("none", "concat('A', capacity, ' and x.', capacity, ' and one')"),
]


def _written(tokens):
    return F.transform(tokens, lambda t: F.concat(t["kind"], F.lit(":"), F.coalesce(t["said"], t["value"].cast("string"))))


@query("f16_fn_extract_numbers", """SELECT station_id, e.form AS form, e.tokens AS tokens FROM (SELECT station_id, unnest([
    {'form': 'clock', 'tokens': 'time:' || (capacity % 12 + 1) || ' AM,time:' || (capacity % 12 + 1) || ' PM'}, {'form': 'noon', 'tokens': 'time:12 PM,time:12 AM'},
    {'form': 'percent', 'tokens': 'percent:' || capacity || '.5,percent:' || capacity || '.0'}, {'form': 'metres', 'tokens': 'meters:' || capacity || '200.0,meters:' || capacity || '.0,number:' || capacity || '.5'},
    {'form': 'ordinal', 'tokens': 'number:' || capacity || '.0,number:2507.0,number:3.0'}, {'form': 'plain', 'tokens': 'number:-' || capacity || '.0,number:20.0'}, {'form': 'none', 'tokens': ''}]) AS e FROM stations)""")
def _(x):
    return _per_station(x, _FIGURES, "text").select("station_id", "form", F.array_join(_written(figures.scan(F.col("text"))), ",").alias("tokens"))


_RECORD = """SELECT *, station_id - 4000 AS k FROM stations"""


def _records(x):
    r = F.struct("name", "capacity", (F.col("capacity") + F.lit(0.5)).alias("unusable_pct"), F.array((F.col("capacity") * 100).alias("x")).alias("subway_distance_m"), F.lit(True).alias("open"), F.lit("opens at 8 a.m., 3rd of 7").alias("note"))
    return x.stations.select("station_id", "capacity", r.alias("record"))


@query("f17_fn_allowed_values", f"""SELECT station_id, array_to_string(list_sort(list_distinct(['number:' || k || '.0', 'number:' || capacity || '.0', 'number:' || capacity || '.5', 'percent:' || capacity || '.5',
    'number:' || (capacity * 100) || '.0', 'meters:' || (capacity * 100) || '.0', 'time:8 AM', 'number:3.0', 'number:7.0'])), ',') AS allowed FROM ({_RECORD})""")
def _(x):
    rows = _records(x)
    return rows.select("station_id", F.array_join(F.array_sort(_written(figures.vocabulary(F.col("record"), rows.schema["record"].dataType))), ",").alias("allowed"))


@query("f18_fn_number_allowed", """SELECT station_id, e.form AS form, e.allowed AS allowed FROM (SELECT station_id, unnest([{'form': 'same', 'allowed': true}, {'form': 'whole', 'allowed': true}, {'form': 'one place', 'allowed': true}, {'form': 'cut', 'allowed': false},
    {'form': 'next', 'allowed': false}, {'form': 'finer', 'allowed': false}]) AS e FROM stations)""")
def _(x):
    forms = [("same", "'.26'"), ("whole", "'.0'"), ("one place", "'.3'"), ("cut", "'.2'"), ("next", "'1.0'"), ("finer", "'.261'")]
    rows = _per_station(x, [(f, f"concat(CASE WHEN '{f}' = 'next' THEN capacity + 1 ELSE capacity END, {'substr(' + e + ', 2)' if f == 'next' else e})") for f, e in forms], "written")

    known = F.array(F.concat("capacity", F.lit(".26")).cast("double"))
    return rows.select("station_id", "form", figures.rounds_to(F.col("written").cast("double"), known).alias("allowed"))


@query("f19_fn_split_sentences", "SELECT station_id, 'Opened by St. Nicholas at 8 a.m. Monday.|' || name || ' is next! |It has 5 p.m. trips to P.S. Shuang and Ave. C?|Yes.' AS sentences FROM (SELECT station_id, name FROM stations)".replace("! |", "!|"))
def _(x):
    text = F.concat(F.lit("Opened by St. Nicholas at 8 a.m. Monday. "), "name", F.lit(" is next!  It has 5 p.m. trips to P.S. Shuang and Ave. C? Yes."))
    return x.stations.select("station_id", F.array_join(figures.sentences(text), "|").alias("sentences"))


# what is said, and the rules it breaks, of a station that fills most at 8 AM and lacks bikes in 13.0 % of readings (12.5 % being usual), and whose type its peaks contradict
_SAID = [
    ("good", "fills most at 8 AM and drains most at 5 PM on weekdays.", ""), ("hour", "fills most at 9 AM on weekdays.", "numbers,peaks"), ("drain hour", "drains most at 8 AM on weekdays.", "peaks"),
    ("percent", "lacks bikes in 14.0% of readings.", "numbers"), ("percent as distance", "is 13 m away.", "numbers"), ("distance", "is 300 meters from P.S. 40.", ""), ("rounded", "lacks bikes in 13 percent of readings.", ""),
    ("no day type", "drains in the evening.", "day type"), ("name tells no time", "is by Night and Day High School.", ""), ("weekend", "peaks at 6 PM on weekends.", "numbers,weekend"), ("worse", "is worse than the system.", ""),
    ("better", "is better than the system.", "comparison"), ("type", "is a commuter-core station.", "hedge"), ("other type", "is a residential feeder station.", "hedge"), ("type in the next sentence", "is grouped with others. It is a commuter core station.", "hedge"),
    ("grouped", "is grouped with commuter-core stations.", ""), ("cause", "empties because of rain.", "style"), ("long", "is. It was. It will. It may.", "style"), ("at once", "fills at 9 AM because offices open.", "numbers,day type,style"),
]


@query("f20_fn_check", "SELECT station_id, e.form AS form, e.broken AS broken FROM (SELECT station_id, unnest([" + ", ".join(f"{{'form': '{f}', 'broken': '{b}'}}" for f, _, b in [*_SAID, ("other name", "", "name")]) + "]) AS e FROM stations)")
def _(x):
    word = lambda t, name: F.lit(t).alias(name)
    record = F.struct(
        "name", word("Commuter core (fills AM, drains PM)", "typology"), word(False, "typology_matches_peak"), word(False, "weekend_differs"),
        F.struct(word(False, "low_signal"), word("8 AM", "fill_peak_hour"), word("5 PM", "drain_peak_hour")).alias("weekday_flow"),
        F.struct(word("ok", "status"), word(13.0, "unusable_pct"), word(12.5, "system_unusable_pct")).alias("reliability"),
        F.struct(word("Night and Day High School", "school_name"), word("P.S. 40", "housing_name"), word(300, "school_threshold_m")).alias("context"))
    rows = _per_station(x, [*((f, f"concat(name, ' {t}')") for f, t, _ in _SAID), ("other name", "'The stop by the park is grouped with none.'")], "text").withColumn("record", record)
    broken = F.array_distinct(F.transform(briefs.violations(F.col("text"), F.col("record"), rows.schema["record"].dataType), lambda v: F.substring_index(v, ":", 1)))
    return rows.select("station_id", "form", F.array_join(broken, ",").alias("broken"))


@query("f22_fn_fill_template", "SELECT station_id, name || ' holds ' || capacity || ' (' || name || ')' AS text FROM stations")
def _(x):

    return x.stations.select("station_id", figures.fill_template("{{name}} holds {{docks}} ({{name}})", {"name": F.col("name"), "docks": F.col("capacity")}).alias("text"))


@query("f28_fn_escape_html", "SELECT station_id, 'A &amp; B &lt;' || name || '&gt; &quot;x&quot; &#39;y&#39;' AS text FROM stations")
def _(x):
    return x.stations.select("station_id", S.escape_html(F.concat(F.lit("A & B <"), "name", F.lit("> \"x\" 'y'"))).alias("text"))
