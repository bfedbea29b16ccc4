"""Embedding whitening by digit-slice GEMM: an exact covariance through float64 BLAS products.

Vectors become integers (floor(256 c), see :func:`integers`), the distinct ones are the fit list, and each is
centred as n x - S, again an integer.  A centred matrix is split into signed digits of ``BITS`` bits; a float64
product of two digit slices of at most ``ROWS`` rows is exact, since every partial sum stays below 2^53.  The slices'
products are recombined as big integers, which are merged over tasks and divided once, correctly rounded.  So the
covariance carries no rounding but its last, whatever the vectors' offset or number.  Its
eigenvectors come from float64 ``eigh``, then the matrix is turned by them exactly (the same sliced products) and
polished by Jacobi rotations, which keep small components right beside large ones.

The driver holds matrices of the vectors' dimension, never rows.  A task holds one batch and its own d x d sums.

Defined results: a vector that is null or holds a null, NaN or infinity is dropped.  Values beyond the long range are held at its
ends.  The dimension is the longest vector's; shorter ones (empty ones too) are filled up by zeros, which does not make them
different from a vector that ends in zeros.  A component without variance (or beyond rounding, 1e-12 of the largest) has
``whitened`` 0 and is left out of the error; without any variance ``explained`` is 0.  ``deviation`` is null where it does not fit a
long.  Repeated rows and ids each give their rows; null ids stay; an empty table gives none; other columns do not matter.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import shared

BITS = 20
ROWS = 1 << 13  # products of two digits are below 2^38 (balanced digits), 2^13 of them below 2^51
_LONG = float(1 << 63)


def integers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, their lengths, all their values one after the other): floor(256 c) of a list column, as longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = column.is_null().to_numpy(zero_copy_only=False)
    values = column.flatten()
    bad = values.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(values.fill_null(0.0).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(lengths)), lengths)
    keep = ~null
    keep[row[bad]] = False
    c = np.floor(values.fill_null(0.0).to_numpy(zero_copy_only=False)[keep[row]] * 256)
    x = np.where(c >= _LONG, np.iinfo(np.int64).max, np.where(c < -_LONG, np.iinfo(np.int64).min, np.clip(c, -_LONG, _LONG - 1024).astype(np.int64)))
    return np.flatnonzero(keep), lengths[keep], x


def dense(lengths: np.ndarray, x: np.ndarray, dim: int) -> np.ndarray:
    """A matrix of ``dim`` columns, filled up by zeros."""
    if len(lengths) and (lengths == dim).all():
        return x.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(x)) - at] = x
    return out


def pack(row: np.ndarray) -> bytes:
    """One byte order for a vector, trailing zeros left off: a width (1, 2, 4 or 8) and the values."""
    end = int(np.flatnonzero(row)[-1]) + 1 if row.any() else 0
    row = row[:end]
    width = next(w for w in (1, 2, 4, 8) if w == 8 or end == 0 or (row.min() >= -(1 << 8 * w - 1) and row.max() < 1 << 8 * w - 1))
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def unpack(keys: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(keys), dim), np.int64)
    for i, k in enumerate(keys):
        v = np.frombuffer(k, f"<i{k[0]}", offset=1)
        out[i, : len(v)] = v
    return out


def digits(a: np.ndarray) -> list[np.ndarray]:
    """Integers as float64 slices of balanced digits, least first: a = sum of slice[i] 2^(BITS i), each within +-2^(BITS - 1)."""
    half, out = 1 << BITS - 1, []
    while not out or np.any(a != 0):
        if a.dtype != object and len(out) > 3:
            a = a.astype(object)
        low = ((a + half) & ((1 << BITS) - 1)) - half
        out.append(low.astype(np.float64))
        a = (a - low) >> BITS
    return out


def gram(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """a^T b (or a^T a) as big integers, through float64 products of digit slices that are exact."""
    total = np.zeros((a.shape[1], (a if b is None else b).shape[1]), object)
    for s in range(0, len(a), ROWS):
        left = digits(a[s : s + ROWS])
        right = left if b is None else digits(b[s : s + ROWS])
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if b is None and j < i:
                    continue  # the other slice's product, transposed
                part = (x.T @ y).astype(np.int64).astype(object)
                total += (part if b is not None or i == j else part + part.T) << (BITS * (i + j))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S; as longs where they fit, else as Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    fits = n * most + max([abs(s) for s in sums], default=0) < 1 << 62
    return (x if fits else x.astype(object)) * n - np.array(sums, np.int64 if fits else object)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Big integers as int64 arrays of signed 32-bit digits, least first: sums of 2^31 of them do not overflow."""
    half, out = 1 << 31, []
    values = values.astype(object)
    while not out or np.any(values != 0):
        low = ((values + half) & ((1 << 32) - 1)) - half
        out.append(low.astype(np.int64))
        values = (values - low) >> 32
    return out


_SUMS = "part int, limb int, size int, digits array<long>"


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Big-integer vectors by ``part``: tasks' digits added in streams that are sorted by part and limb, one vector each at the end."""
    def add(batches):
        key, total = None, None
        for batch in batches:
            for part, limb, _, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, limb) != key:
                    if key is not None:
                        yield _record([(*key, len(total), total.tolist())])
                    key, total = (part, limb), np.zeros(len(v), np.int64)
                total += np.array(v, np.int64)
        if key is not None:
            yield _record([(*key, len(total), total.tolist())])

    merged = rows.repartition("part", "limb").sortWithinPartitions("part", "limb").mapInArrow(add, _SUMS)
    out: dict[int, np.ndarray] = {}
    for r in merged.toLocalIterator():
        out[r.part] = out.get(r.part, 0) + (np.array(r.digits, np.int64).astype(object) << (32 * r.limb))
    return out


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["part", "limb", "size", "digits"])


def fit_list(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(a written table of every distinct integer vector once, as ``key``; the dimension).  Repeats are dropped before the shuffle too."""
    spark = vectors.sparkSession
    shared.prepare(spark)

    def keys(batches):
        for batch in batches:
            _, lengths, x = integers(batch.column(0))
            for i in range(0, len(lengths), 4096):
                own = lengths[i : i + 4096]
                at = np.concatenate([[0], np.cumsum(own)])
                part, x = x[: at[-1]], x[at[-1] :]
                found = [pack(part[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(own, pa.int64())], names=["key", "size"])

    each = vectors.select(vector).mapInArrow(keys, "key binary, size long")
    fit = shared.materialise(each.groupBy("key").agg(F.max("size").alias("size")), "fit-list")
    return fit, int(fit.agg(F.max("size")).first()[0] or 0)


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""
    def run(batches):
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = unpack(batch.column(0).to_pylist(), dim)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        total = np.concatenate([[n], low.astype(object) + (high.astype(object) << 32)])
        yield _record([(0, k, dim + 1, d.tolist()) for k, d in enumerate(_limbs(total))])

    found = _summed(fit.select("key").mapInArrow(run, _SUMS)).get(0, np.zeros(dim + 1, object))
    return int(found[0]), [int(v) for v in found[1:]]


def scatter(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the fit list of (n x - S)(n x - S)^T, as big integers."""
    def run(batches):
        total = np.zeros((dim, dim), object)
        for batch in batches:
            keys = batch.column(0)
            for i in range(0, len(keys), ROWS):
                total = total + gram(centred(unpack(keys.slice(i, ROWS).to_pylist(), dim), n, sums))
        rows = [(r, k, dim - r, d.tolist()) for r in range(dim) for k, d in enumerate(_limbs(total[r, r:]))]
        for i in range(0, len(rows), 256):
            yield _record(rows[i : i + 256])

    out = np.zeros((dim, dim), object)
    for r, upper in _summed(fit.select("key").mapInArrow(run, _SUMS)).items():
        out[r, r:] = upper
        out[r:, r] = upper
    return out


def jacobi(a: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a nearly diagonal symmetric matrix, small values to their own precision."""
    a, v, d = a.copy(), np.eye(len(a)), len(a)
    for _ in range(sweeps):
        limit = 1e-17 * np.sqrt(np.abs(np.outer(a.diagonal(), a.diagonal())))
        todo = np.argwhere(np.triu(np.abs(a) > limit, 1))
        if not len(todo):
            break
        for i, j in todo:
            if a[i, j] == 0:
                continue
            with np.errstate(over="ignore"):
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(t, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            p, q = a[i, i] - t * a[i, j], a[j, j] + t * a[i, j]
            x, y = a[:, i].copy(), a[:, j].copy()
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            a[i], a[j] = a[:, i], a[:, j]
            a[i, i], a[j, j], a[i, j], a[j, i] = p, q, 0.0, 0.0
            x, y = v[:, i].copy(), v[:, j].copy()
            v[:, i], v[:, j] = c * x - s * y, s * x + c * y
    return a.diagonal().copy(), v


def decompose(exact: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the big-integer matrix ``exact`` / ``scale``."""
    d = len(exact)
    trace = sum(int(v) for v in exact.diagonal()) / scale if d else 0.0
    if trace == 0:
        return np.zeros(d), np.eye(d), 0.0
    a = np.array([[int(v) / scale for v in row] for row in exact], float)
    vectors = np.linalg.eigh(a / trace)[1]
    for _ in range(2):
        fixed = np.array([[round(v * 2.0**60) for v in row] for row in vectors], object)  # 2^60 e is an integer near enough
        turned = gram(gram(exact, fixed), fixed)  # V symmetric: (V E)^T E
        near = np.array([[int(v) / (scale << 120) for v in row] for row in turned], float)
        values, turn = jacobi((near + near.T) / 2)
        vectors = vectors @ turn
        vectors /= np.linalg.norm(vectors, axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order], trace


@dataclass
class Whitener:
    """What projects a vector: the fit list's number and sums, components as columns already divided by the root of their eigenvalue."""

    dim: int
    n: int
    sums: list
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        """(deviations, whitened values) of integer rows."""
        y = centred(x, self.n, self.sums)
        if y.dtype != object and len(y) and max(int(y.max(initial=0)), -int(y.min(initial=0))) ** 2 * max(1, self.dim) < 1 << 63:
            far = (y * y).sum(axis=1).tolist()
        else:
            far = [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in y)]
        return far, (y / self.n).astype(np.float64) @ self.axes


def fit(vectors: DataFrame, components: int = 4, vector: str = "embedding") -> Whitener:
    """Components over the distinct integer vectors; reads ``vectors`` once and the fit list three times."""
    rows, dim = fit_list(vectors, vector)
    n, sums = moments(rows, dim)
    k = min(components, dim)
    if n == 0:
        return Whitener(dim, 0, [0] * dim, np.zeros(k), np.zeros((dim, k)), np.zeros(k))
    values, axes, trace = decompose(scatter(rows, dim, n, sums), n**3)
    values, axes = values[:k], axes[:, :k]
    some = values > 1e-12 * max(values.max(initial=0.0), 0.0)
    scaled = np.where(some, axes / np.sqrt(np.where(some, values, 1.0)), 0.0)
    w = Whitener(dim, n, sums, values, scaled, np.where(some, values, 0.0) / trace if trace else np.zeros(k))
    w.identity_error = _identity_error(rows, w, some)
    shared.drop_table(rows)
    return w


def _identity_error(rows: DataFrame, w: Whitener, some: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened values less the identity, as measured on these."""
    k = len(some)

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            keys = batch.column(0)
            for i in range(0, len(keys), ROWS):
                v = w.apply(unpack(keys.slice(i, ROWS).to_pylist(), w.dim))[1]
                total[0] += v.sum(axis=0)
                total[1:] += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1), pa.float64())], names=["at", "v"])

    found = rows.select("key").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k (k + 1) rows
    total = np.zeros(k * (k + 1))
    for r in found:
        total[r["at"]] = r["v"]
    total = total.reshape(k + 1, k) / w.n
    error = total[1:] - np.outer(total[0], total[0]) - np.eye(k)
    return float(np.abs(error[np.ix_(some, some)]).max(initial=0.0))


def whiten(vectors: DataFrame, w: Whitener, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    shared.prepare(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(w)  # dimension x components numbers
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        m = sent.value
        k = len(m.values)
        for batch in batches:
            keep, lengths, x = integers(batch.column(1))
            far, v = m.apply(dense(lengths, x, m.dim))
            rows = len(keep)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(keep, k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m.n), pa.int64()),
                pa.array([f for f in far for _ in range(k)], pa.int64()), pa.array(v.reshape(-1), pa.float64()),
                pa.array(np.tile(m.explained, rows), pa.float64()), pa.array(np.full(rows * k, m.identity_error), pa.float64())], names=names)

    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
