"""Column functions: distances, curves as arrays of 24 values, labels, bins.  All stay inside generated code."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewheel import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_s(start, end) -> Column:
    """Fractional seconds between two times."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def haversine(lat1, lng1, lat2, lng2, radius: float = C.EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def day_type(ts) -> Column:
    return F.when(F.weekday(col(ts)) >= 5, "weekend").otherwise("weekday")


def month_key(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def season(month_key_col) -> Column:
    m = F.substring(col(month_key_col), 6, 2).cast("int")
    return F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("fall")


def l2_norm(curve) -> Column:
    return F.sqrt(F.aggregate(col(curve), F.lit(0.0), lambda s, v: s + v * v))


def l2_normalize(curve) -> Column:
    n = l2_norm(curve)
    return F.transform(col(curve), lambda v: F.try_divide(v, n))


def mean_abs(curve) -> Column:
    return F.aggregate(col(curve), F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size(col(curve))


def hour_sum(curve, hours) -> Column:
    """Sum over some hours, in order."""
    total = F.element_at(col(curve), hours[0] + 1)
    for h in hours[1:]:
        total = total + F.element_at(col(curve), h + 1)
    return total


def first_max_hour(curve) -> Column:
    return (F.array_position(col(curve), F.array_max(col(curve))) - 1).cast("int")


def first_min_hour(curve) -> Column:
    return (F.array_position(col(curve), F.array_min(col(curve))) - 1).cast("int")


def fill_hour(curve) -> Column:
    """First hour of the largest value, null if that rounds to 0.0 or less."""
    return F.when(F.bround(F.array_max(col(curve)), 1) > 0, first_max_hour(curve))


def drain_hour(curve) -> Column:
    return F.when(F.bround(-F.array_min(col(curve)), 1) > 0, first_min_hour(curve))


def hour_label(h) -> Column:
    h = col(h)
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.when(h.isNotNull(), F.concat(twelve.cast("string"), F.when(h < 12, " AM").otherwise(" PM")))


def hour_gap(a, b) -> Column:
    g = F.abs(col(a) - col(b)) % 24
    return F.least(g, 24 - g)


def ordinal(n) -> Column:
    n = col(n)
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(F.format_number(n, 0), tail)


def precip_bin(p) -> Column:
    """Right-closed bins; null outside the first edge."""
    p = col(p)
    return F.when(p <= -0.01, None).when(p <= 0.1, "dry").when(p <= 5, "light").when(p <= 20, "moderate").when(p > 20, "heavy")


def extrapolation_tier(t, low, high, margin: float = C.EXTRAPOLATION_C) -> Column:
    t, low, high = col(t), col(low), col(high)
    return F.when((t >= low) & (t <= high), "gbm").when((t >= low - margin) & (t <= high + margin), "gam").otherwise("naive")


def weekend_differs(weekday, weekend, weekday_low, weekend_low) -> Column:
    """Null with a low signal on either side; else whether a compared peak moved by two hours or more."""
    moved = lambda f: F.coalesce(hour_gap(f(weekday), f(weekend)) >= C.MIN_PEAK_SHIFT, F.lit(False))
    return F.when(~(col(weekday_low) | col(weekend_low)), moved(fill_hour) | moved(drain_hour))


def typology_matches(name, weekday, weekday_low) -> Column:
    """Whether the AM side of the type's name peaks in the morning and its PM side at noon or later."""
    f, d = fill_hour(weekday), drain_hour(weekday)
    fills_am = col(name).contains("fills AM")
    am, pm = F.when(fills_am, f).otherwise(d), F.when(fills_am, d).otherwise(f)
    ok = F.coalesce(am.between(C.MORNING_HOURS[0], C.MORNING_HOURS[-1]) & (pm >= 12), F.lit(False))
    return F.when(~col(weekday_low) & (fills_am | col(name).contains("drains AM")), ok)


def normalize_name(c) -> Column:
    """Case, '&' and punctuation do not tell station names apart."""
    c = F.regexp_replace(F.lower(col(c)), "&", " and ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def spline_basis(x, knots: list[float], degree: int = 3) -> list[Column]:
    """B-spline basis functions of ``x`` on evenly spaced knots, constant beyond the ends."""
    x = F.least(F.greatest(col(x), F.lit(knots[0])), F.lit(knots[-1]))
    step = knots[1] - knots[0]
    t = [knots[0] - step * (degree - i) for i in range(degree)] + list(knots) + [knots[-1] + step * (i + 1) for i in range(degree)]
    last = degree + len(knots) - 2
    basis = [F.when((x >= F.lit(t[i])) & ((x < F.lit(t[i + 1])) | F.lit(i == last)), 1.0).otherwise(0.0) if i <= last else F.lit(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        basis = [(x - F.lit(t[i])) / F.lit(t[i + d] - t[i]) * basis[i] + (F.lit(t[i + d + 1]) - x) / F.lit(t[i + d + 1] - t[i + 1]) * basis[i + 1] for i in range(len(t) - d - 1)]
    return basis


def escape_html(c) -> Column:
    """Text that may stand in HTML, in quotes too."""
    out = col(c)
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(written))
    return out
