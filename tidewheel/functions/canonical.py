"""Canonical JSON as a column expression: one text for equal records, however their keys are ordered.

Compact (no blanks), keys of structs and maps sorted by code point at every level, nulls written, text unescaped but for
quotes, backslashes and control characters, numbers as the shortest text that reads back as the same double (1.0, 0.001, 1e+16).
The expression is built from the column's type, so records are hashed inside the JVM, without a Python worker.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_CONTROLS = {chr(i): _SHORT.get(chr(i), f"\\u{i:04x}") for i in range(32)}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: as a lambda's variable, where an expression would stand in the plan as often as it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(c: Column) -> Column:
    """A JSON string."""
    def escaped(plain: Column) -> Column:
        rare = plain
        for sign, written in _CONTROLS.items():
            rare = F.replace(rare, F.lit(sign), F.lit(written))
        return F.concat(F.lit('"'), F.when(plain.rlike("[\\x00-\\x1f]"), rare).otherwise(plain), F.lit('"'))

    return _let(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), escaped)


def number(c: Column) -> Column:
    """The shortest text of a double: positional from 1e-4 to below 1e16, else with an exponent of two digits at least.

    Doubles have 15 digits that always come back and 17 that always tell them; below 2.3e-308 fewer may do.
    """
    def shortest(size: Column) -> Column:
        tries = lambda digits: [_let(F.format_string(f"%.{p}e", size), lambda t: F.when(t.try_cast("double") == size, t)) for p in digits]
        few = F.when((size > 0) & (size < 2.3e-308), F.coalesce(*tries(range(14))))
        return F.coalesce(few, *tries((14, 15)), F.format_string("%.16e", size))

    def written(t: Column) -> Column:
        d, e = t["d"], t["e"]
        n = F.length(d)
        positional = (F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
                      .when(e >= n - 1, F.concat(d, F.repeat(F.lit("0"), e - n + 1), F.lit(".0")))
                      .otherwise(F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))))
        short = F.when(n == 1, d).otherwise(F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, F.lit(2), n)))
        power = F.concat(short, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        return F.when(e.between(-4, 15), positional).otherwise(power)

    digits = lambda t: F.rtrim(F.replace(F.substring_index(t, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
    split = lambda t: F.struct(F.coalesce(F.nullif(digits(t), F.lit("")), F.lit("0")).alias("d"), F.substring_index(t, "e", -1).try_cast("int").alias("e"))
    told = _let(_let(_let(F.abs(c), shortest), split), written)
    sign = F.when((c < 0) | ((c == 0) & F.startswith(c.cast("string"), F.lit("-"))), "-").otherwise("")
    return F.when(c.isNull(), F.lit(None)).when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, told))


def canonical(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of type ``kind``; null is the text null.

    Decimals are written as plain numbers, dates, times and bytes as Spark casts them to text, quoted; keys of maps must be text.
    """
    if isinstance(kind, T.StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        inner = fields[:1] + [x for f in fields[1:] for x in (F.lit(","), f)]
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), *inner, F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(quoted(k.cast("string")), F.lit(":"), canonical(F.element_at(c, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(c.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = c.cast("string")
    else:
        out = quoted(c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def record(df: DataFrame, columns: list[str]) -> Column:
    """Canonical JSON of some columns as one object."""
    kind = T.StructType([df.schema[c] for c in columns])
    return canonical(F.struct(*[F.col(c) for c in columns]), kind)


def record_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 (lowercase hex) of the canonical JSON of some columns, in UTF-8."""
    return F.sha2(record(df, columns).cast("binary"), 256)
