"""Additive models over splines and classes: Poisson with a log link by reweighted least squares, or ridge.

A design is a list of named columns, so predictions are one JVM expression and no row leaves Spark.  A fit takes
sums of d x d products (Arrow batches, d some tens), added up by Spark; the driver solves d equations a step.  The
intercept is never penalised.  With n rows and weights w the Poisson fit minimises mean(exp(eta) - y eta) + alpha / 2 |w|^2, the
ridge sum((y - eta)^2) + alpha |w|^2.

Defined results: rows with a null in the target or a numeric column are not learnt from; a class not seen in training (null is a class of its own)
adds nothing; without rows, and for counts without a positive sum, only the intercept is fitted (of 0, or log 1e-15).
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.functions import scalars as S
from tidewheel.session import at_once, cut, prepare_workers

NONE = "(none)"


def periodic_basis(x, low: float, high: float, intervals: int) -> list[Column]:
    """Cubic B-splines of ``x`` on ``intervals`` even intervals from ``low`` to ``high``, which is the period: as many functions, which sum to 1."""
    step = (high - low) / intervals
    place = (S.col(x) - F.lit(low)) / F.lit(step)
    u = place - F.floor(place / intervals) * intervals  # in [0, intervals)
    out = []
    for i in range(intervals):
        t = F.lit(0.0)
        for turn in range(-(4 // intervals) - 1, 2):  # the bump over [i, i + 4), seen from every turn that reaches u
            v = u - F.lit(float(i + turn * intervals))
            a, b, c = v - 1, v - 2, 4 - v
            bump = (F.when((v >= 0) & (v < 1), v * v * v / 6)
                    .when((v >= 1) & (v < 2), (1 + 3 * a + 3 * a * a - 3 * a * a * a) / 6)
                    .when((v >= 2) & (v < 3), (4 - 6 * b * b + 3 * b * b * b) / 6)
                    .when((v >= 3) & (v < 4), c * c * c / 6).otherwise(0.0))
            t = t + bump
        out.append(t)
    return out


@dataclass
class Design:
    """What turns a row into numbers: an open spline, a periodic one, classes (one column each) and plain columns."""

    spline: tuple[str, list[float]] | None = None
    cycle: tuple[str, float, float, int] | None = None
    classes: dict[str, list[str]] = field(default_factory=dict)
    plain: list[str] = field(default_factory=list)

    def columns(self) -> list[Column]:
        out = S.spline_basis(F.col(self.spline[0]).cast("double"), self.spline[1]) if self.spline else []
        out += periodic_basis(F.col(self.cycle[0]).cast("double"), *self.cycle[1:]) if self.cycle else []
        for c, own in self.classes.items():
            out += [(F.coalesce(F.col(c).cast("string"), F.lit(NONE)) == v).cast("double") for v in own]
        return out + [F.col(c).cast("double") for c in self.plain]


def design(train: DataFrame, spline: str, cycle: str, classes: list[str], plain: list[str], knots: int = 5, cycle_knots: int = 6) -> Design:
    """Knots evenly between the extremes of training, the cycle's too (its period is their distance); classes as training has them."""
    low, high, first, last = train.agg(F.min(spline), F.max(spline), F.min(cycle), F.max(cycle)).first()
    kinds = at_once([lambda c=c: sorted(r[0] for r in train.select(F.coalesce(F.col(c).cast("string"), F.lit(NONE))).distinct().limit(4097).collect()) for c in classes])
    if any(len(k) > 4096 for k in kinds):
        raise ValueError("a class column has more than 4096 values")
    at = [low + (high - low) * i / (knots - 1) for i in range(knots)] if high is not None and high > low else [float(i) for i in range(knots)]
    return Design((spline, [float(v) for v in at]), (cycle, float(first), float(last), cycle_knots - 1) if last is not None and last > first else None, dict(zip(classes, kinds)), list(plain))


@dataclass
class Additive:
    """A fitted model; ``eta`` is its linear predictor as a column."""

    design: Design
    intercept: float
    weights: np.ndarray
    counts: bool
    steps: int = 0

    def eta(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.design.columns(), self.weights):
            out = out + c * F.lit(float(w))
        return out

    def column(self) -> Column:
        return F.exp(self.eta()) if self.counts else self.eta()


def _sums(rows: DataFrame, d: int, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(X'WX, X'r, loss, rows) with a leading column of ones: for counts at ``weights`` W is the mean and r mean - y, without weights W is 1 and r is y."""
    def run(batches):
        total = np.zeros((d + 1) * (d + 2) + 2)
        for batch in batches:
            n = batch.num_rows
            x = np.concatenate([np.ones((n, 1)), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, d)], axis=1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if weights is None:
                w, r, loss = np.ones(n), y, float((y * y).sum())
            else:
                eta = x @ weights
                w = np.exp(np.minimum(eta, 700))
                r, loss = w - y, float((w - y * eta).sum())
            total += np.concatenate([((x * w[:, None]).T @ x).reshape(-1), x.T @ r, [loss, n]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])

    found = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # (d + 1) (d + 2) + 2 numbers
    total = np.zeros((d + 1) * (d + 2) + 2)
    for r in found:
        total[r["at"]] = r["v"]
    k = (d + 1) ** 2
    return total[:k].reshape(d + 1, d + 1), total[k:-2], float(total[-2]), float(total[-1])


def matrix(train: DataFrame, targets: list[str], how: Design) -> DataFrame:
    """The design's numbers ``x`` of each row, and its ``targets``, computed once for all fits; rows without one of the numbers are left out."""
    prepare_workers(train.sparkSession)
    d = len(how.columns())
    rows = train.select(F.array(*how.columns()).cast("array<double>").alias("x"), *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)])

    def whole(batches):  # as a condition of Spark's it would be pushed below the design and compute it twice
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            yield batch.filter(pa.array(~np.isnan(x).any(axis=1)))

    return cut(rows.mapInArrow(whole, rows.schema))


def fit(train: DataFrame, target: str, how: Design, counts: bool, alpha: float = 1.0, tolerance: float = 1e-10, most_steps: int = 100) -> Additive:
    """Least squares in one pass, or Newton steps (halved while they do not lower the loss) until the gradient is below ``tolerance``."""
    return fit_rows(matrix(train, [target], how), "y0", how, counts, alpha, tolerance, most_steps)


def fit_rows(rows: DataFrame, target: str, how: Design, counts: bool, alpha: float = 1.0, tolerance: float = 1e-10, most_steps: int = 100) -> Additive:
    """:func:`fit` to the column ``target`` of a :func:`matrix`."""
    d = len(how.columns())
    rows = rows.select("x", F.col(target).alias("y")).filter("y IS NOT NULL AND NOT isnan(y)")
    penalty = np.full(d + 1, alpha)
    penalty[0] = 0.0
    if not counts:
        xx, xy, _, n = _sums(rows, d, None)
        if not n:
            return Additive(how, 0.0, np.zeros(d), False)
        # by sums about the means, as the intercept is free
        mean, y_mean = xx[0, 1:] / n, xy[0] / n
        w = np.linalg.solve(xx[1:, 1:] - n * np.outer(mean, mean) + alpha * np.eye(d), xy[1:] - n * mean * y_mean)
        return Additive(how, float(y_mean - mean @ w), w, False, 1)
    n, total = rows.agg(F.count("*"), F.sum("y")).first()
    b = np.zeros(d + 1)
    b[0] = np.log(max((total or 0.0) / max(n, 1), 1e-15))
    if not n or not total:
        return Additive(how, float(b[0]), b[1:], True)
    xwx, xr, loss, _ = _sums(rows, d, b)
    steps = 0
    while steps < most_steps:
        gradient = xr / n + penalty * b
        if np.abs(gradient).max() <= tolerance:
            break
        step = np.linalg.solve(xwx / n + np.diag(penalty) + 1e-14 * np.eye(d + 1), gradient)
        now, size, moved = loss / n + 0.5 * (penalty * b * b).sum(), 1.0, False
        while size > 1e-8:
            b_new = b - size * step
            found = _sums(rows, d, b_new)
            steps += 1
            if found[2] / n + 0.5 * (penalty * b_new * b_new).sum() <= now + 1e-15 * abs(now):
                moved = True
                break
            size /= 2
        if not moved:
            break
        b, (xwx, xr, loss, _) = b_new, found
    return Additive(how, float(b[0]), b[1:], True, steps)
