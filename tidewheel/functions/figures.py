"""Figures in texts as column expressions: one scanner, a vocabulary of what a record allows, sentences, rounding.

Everything stays in the JVM: ``regexp_extract_all`` finds the tokens, higher-order functions tell their kinds, and what a
record allows is built from its type.  A null text has no figures and no sentences.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, functions as F, types as T

from tidewheel.functions.canonical import _let

# Number words, abbreviations that end in a full stop.
NUMBER_WORDS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
ABBREVIATIONS = ("St.", "Av.", "Ave.", "Sq.", "Dr.", "Mt.", "Jr.", "a.m.", "p.m.")
TIME, PERCENT, METERS, NUMBER = "time", "percent", "meters", "number"

TOKENS = "array<struct<kind: string, value: double, said: string>>"  # a time is said ("8 AM"), all else has a value

_HOUR = r"([0-9]{1,2})(?::00)?\s*([ap])\.?\s*m"
_FIGURE = r"-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
_UNIT = r"(?:\s*(?:%|percent(?!\w))|\s*(?:m|meters|metres)(?!\w)|(?:st|nd|rd|th)(?!\w))?"
_SCAN = rf"(?iU)(?<!\w){_HOUR}(?!\w)|(?<!\w)(?:noon|midnight)(?!\w)|(?<![\w.]){_FIGURE}{_UNIT}|[a-z]+"


def none(kind: str = TOKENS) -> Column:
    """An empty array of ``kind``."""
    return F.array().cast(kind)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(tests: Iterator[Column] | list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _token(kind, value=None, said=None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(value).cast("double").alias("value"), F.lit(said).cast("string").alias("said"))


def _told(m: Column) -> Column:
    """The token that a match is, or null (a word that is no number)."""
    hour, half = (F.regexp_extract(m, rf"(?iU)^{_HOUR}$", i) for i in (1, 2))
    words = F.expr("map({})".format(", ".join(f"'{w}', {n}" for w, n in NUMBER_WORDS.items())))

    def figure(v: Column) -> Column:
        whole = m.rlike(r"(?iU)(?:m|meters|metres)$") & (v == F.floor(v))
        return F.when(m.rlike("(?iU)(?:%|percent)$"), _token(PERCENT, F.abs(v))).when(whole, _token(METERS, F.abs(v))).otherwise(_token(NUMBER, v))

    value = F.replace(F.regexp_extract(m, f"^{_FIGURE}", 0), F.lit(","), F.lit("")).try_cast("double")
    word = F.try_element_at(words, F.lower(m))
    return (F.when(hour != "", _token(TIME, None, F.concat(hour.try_cast("int").cast("string"), F.lit(" "), F.upper(half), F.lit("M"))))
            .when(F.lower(m) == "noon", _token(TIME, None, "12 PM")).when(F.lower(m) == "midnight", _token(TIME, None, "12 AM"))
            .when(m.rlike("^-?[0-9]"), _let(value, figure)).when(word.isNotNull(), _token(NUMBER, word)))


def scan(text: Column) -> Column:
    """Times, percentages, distances and numbers in the order they stand: a figure and what unit follows it, or a word.

    One pass: a figure that a time or a percentage took is not read again.  "one" and "first" are words.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SCAN), F.lit(0))
    return F.filter(F.transform(found, _told), lambda t: t.isNotNull()).cast(TOKENS)


def leaves(value: Column, kind: T.DataType, each: Callable[[Column, Column, T.DataType], Column | None], empty: Column, field: Column | None = None) -> Column:
    """The arrays that ``each`` (field's name, value, type) gives for every plain value of a nested one, behind one another.

    Members of arrays carry the array's name, those of maps their key; a null anywhere gives nothing.
    """
    field = F.lit("") if field is None else field
    if isinstance(kind, T.StructType):
        parts = [leaves(value[f.name], f.dataType, each, empty, F.lit(f.name)) for f in kind]
        return F.concat(empty, *[p for p in parts if p is not empty])
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda v: leaves(v, kind.elementType, each, empty, field))), empty)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, each, empty, e["key"].cast("string")))), empty)
    got = each(field, value, kind)  # None: nothing of this type is asked for
    return empty if got is None else F.when(value.isNull(), empty).otherwise(got)


def vocabulary(record: Column, kind: T.DataType) -> Column:
    """What a text about a record may say, as distinct tokens.

    A number of the record may stand as a plain number; one of a ``*_pct`` field as a percentage too, one of a ``*_m``
    field as a distance too.  What stands inside a text of the record may be repeated as the kind it has there, or as a number.
    """
    def number(field: Column, value: Column, kind: T.DataType) -> Column | None:
        return F.array(F.struct(field.alias("field"), value.cast("double").alias("value"))) if isinstance(kind, T.NumericType) else None

    def kinds(n: Column) -> Column:
        as_kind = lambda ending, k: F.when(F.endswith(n["field"], F.lit(ending)), _token(k, n["value"]))
        return F.array(_token(NUMBER, n["value"]), as_kind("_pct", PERCENT), as_kind("_m", METERS))

    def said(text: Column) -> Column:
        return _let(scan(text), lambda tokens: F.concat(tokens, F.transform(F.filter(tokens, lambda t: t["kind"] != TIME), lambda t: _token(NUMBER, t["value"]))))

    numbers = F.flatten(F.transform(leaves(record, kind, number, none("array<struct<field: string, value: double>>")), kinds))
    texts = F.flatten(F.transform(strings(record, kind), said))
    return F.array_distinct(F.array_compact(F.concat(numbers, texts)))


def strings(record: Column, kind: T.DataType) -> Column:
    """The distinct texts inside a record, dates as they are written."""
    other = (T.BooleanType, T.NumericType)
    return F.array_distinct(leaves(record, kind, lambda _, v, k: None if isinstance(k, other) else F.array(v.cast("string")), none("array<string>")))


def rounds_to(written: Column, known: Column) -> Column:
    """Whether some known number, rounded to as many places as the written one has, is the written one.

    Rounding is that of the binary value (2.675 is 2.67 at two places), halves to even, as ``format_number`` does it; ``bround`` would round the shortest decimal.
    """
    decimals = F.regexp_extract(written.try_cast("decimal(38,18)").cast("string"), r"\.([0-9]*[1-9])0*$", 1)
    rounded = lambda k, places: F.replace(F.call_function("format_number", k, places), F.lit(","), F.lit("")).try_cast("double")
    return _let(F.coalesce(F.length(decimals), F.lit(0)), lambda places: F.exists(known, lambda k: F.coalesce((k == written) | (rounded(k, places) == written), F.lit(False))))


def allows(known: Column, token: Column) -> Column:
    """Whether a vocabulary has a token: a time as it is, all else rounded from one of its kind."""
    same = F.filter(known, lambda k: k["kind"] == token["kind"])
    return F.when(token["kind"] == TIME, F.exists(same, lambda k: k["said"] == token["said"])).otherwise(rounds_to(token["value"], F.transform(same, lambda k: k["value"])))


_STOPS = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')})" for a in ABBREVIATIONS)
_BREAK = rf"(?U)(?<=[.!?])(?<!\b[A-Z]\.){_STOPS}\s+(?=[A-Z])"


def sentences(text: Column) -> Column:
    """Parts that end in a stop before a capital; initials, streets' abbreviations, a.m. and p.m. end none."""
    return F.filter(F.split(strip(F.coalesce(text, F.lit(""))), _BREAK), lambda s: s != "")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by a column; a name without one raises before anything runs, a null value gives nothing.

    What a value holds is not read as a template again.
    """
    import re

    pieces = re.split(r"\{\{(\w+)\}\}", template)
    if missing := sorted(set(pieces[1::2]) - values.keys()):
        raise KeyError(f"no value for {missing}")
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
