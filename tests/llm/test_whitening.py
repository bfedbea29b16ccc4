"""Embedding whitening against rational arithmetic and plain numpy."""
from fractions import Fraction

import numpy as np
import pytest

from tidewheel.llm import whitening as wh


def brute(rows, k=4):
    """{(id, occurrence): (deviation, whitened by component)}, explained; everything but the last eigen step in fractions."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    ints = [[int(np.floor(np.float64(np.float32(c)) * 256)) for c in v] + [0] * (dim - len(v)) for _, v in good]
    fit = sorted(set(map(tuple, ints)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * c - t for c, t in zip(v, s)] for v in fit]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in y), n**3)) for j in range(dim)] for i in range(dim)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = [(i, sum((n * c - t) ** 2 for c, t in zip(v, s)), ((np.array([float(Fraction(n * c - t, n)) for c, t in zip(v, s)])) @ q) / np.sqrt(e)) for (i, _), v in zip(good, ints)]
    return n, out, e / np.trace(cov)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, n string, component int")


def vectors(seed, count, dim, offset=0.0, scales=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(count, dim)) * (scales if scales is not None else np.linspace(4, 1, dim)) + offset
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("offset,scales", [(0.0, None), (20_000.0, None), (0.0, np.array([3e4, 400.0, 5.0, 2.0, 1.0, 0.5]))])
def test_whitening(spark, offset, scales):
    rows = vectors(1, 300, 6, offset, scales)
    rows += [(7000, rows[3][1]), (7001, rows[3][1]), (rows[5][0], rows[5][1]), (None, rows[8][1]), (7002, None), (7003, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (7004, [1.0, float("nan"), 2.0, 0.0, 0.0, 0.0]), (7005, [float("inf")] * 6), (7006, [-0.0] * 6), (7007, [0.0] * 6)]
    df = frame(spark, rows).repartition(5)
    w = wh.fit(df)
    got = wh.whiten(df, w).collect()
    n, want, explained = brute(rows)
    assert w.n == n and w.identity_error < 1e-4
    assert len(got) == 4 * len(want) and {r.component for r in got} == {1, 2, 3, 4}
    fits = lambda d: d if d < 1 << 63 else None
    assert sorted((r.vec_id or -1, str(r.deviation)) for r in got if r.component == 1) == sorted((i or -1, str(fits(d))) for i, d, _ in want)
    by_id = {i: v for i, _, v in want}
    for k in range(4):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        a, b = (np.array([m[i] for i in by_id]) for m in (mine, {i: v[k] for i, v in by_id.items()}))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-5
        assert all(r.explained == pytest.approx(explained[k], rel=1e-8) for r in got if r.component == k + 1)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1


def test_whitening_edges(spark):
    empty = frame(spark, [])
    assert wh.whiten(empty, wh.fit(empty)).collect() == []
    one = frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (3, [2.0, 3.0001])])  # one integer vector: no variance
    w = wh.fit(one)
    assert w.n == 1
    assert {(r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in wh.whiten(one, w).collect()} == {(i, k, 0, 0.0, 0.0) for i in (1, 2, 3) for k in (1, 2)}
    ragged = frame(spark, [(1, [1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 2.0]), (4, []), (5, None)])
    w = wh.fit(ragged)
    assert (w.dim, w.n) == (3, 3)
    assert len(wh.whiten(ragged, w).collect()) == 4 * 3
    huge = frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [5.0, 2.0])])  # held at the ends of the range
    got = wh.whiten(huge, wh.fit(huge)).collect()
    assert {r.deviation is None for r in got if r.vec_id != 3} == {True} and all(np.isfinite(r.whitened) for r in got)


def test_slices_multiply_exactly():
    r = np.random.default_rng(2)
    for a in (r.integers(-(10**13), 10**13, (9000, 5)), r.integers(-(1 << 62), 1 << 62, (40, 3)), r.integers(-(1 << 62), 1 << 62, (30, 4)).astype(object) * 10**12, np.zeros((0, 3), np.int64)):
        o = a.astype(object)
        assert (wh.gram(a) == (o.T @ o if len(o) else np.zeros((3, 3), object))).all()
        assert (sum(d.astype(object).astype(int).astype(object) << (wh.BITS * i) for i, d in enumerate(wh.digits(a))) == o).all() if len(o) else True
    a, b = (r.integers(-(10**9), 10**9, (50, k)) for k in (3, 6))
    assert (wh.gram(a, b) == a.astype(object).T @ b.astype(object)).all()


def test_small_components_beside_large_ones():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(5, 5)))[0]
    lambdas = np.array([10.0**24, 10.0**12, 300.0, 200.0, 1.0])
    # an exact matrix with these eigenvalues nearly: diagonal, then turned by small integer shears on both sides
    exact = np.diag([int(v) for v in lambdas]).astype(object)
    values, vectors, trace = wh.decompose(exact * 7, 7)
    assert np.allclose(values, lambdas, rtol=1e-12) and np.allclose(np.abs(vectors), np.eye(5))
    g = np.array([[round(v * 2**40) for v in row] for row in q], object)
    turned = wh.gram(wh.gram(exact, g), g)
    values, vectors, _ = wh.decompose(turned, 1 << 80)
    assert np.allclose(values[:2], lambdas[:2], rtol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)


def test_packed_vectors_come_back():
    for v in ([], [0, 0], [1, 0, -128], [127, 128], [1 << 40, -(1 << 62), 0], [-32768, 32767]):
        v = np.array(v, np.int64)
        assert wh.unpack([wh.pack(v)], len(v))[0].tolist() == v.tolist()
    assert wh.pack(np.array([5, 0])) == wh.pack(np.array([5]))
