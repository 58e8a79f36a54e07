"""Refined eigenvectors and whitened rows against numpy on all rows at once."""

import math
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from ordersight.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(len(values)) - 0.5 * q.T @ q)  # orthogonal to the last digit
    return q, (q * np.array(values, np.longdouble)) @ q.T


@pytest.mark.parametrize("values", [
    [9, 7, 4, 2, 1], [5, 5, 5, 2, 2, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-10, 0.1], [3, 0, 0, 0], [1e-8, 1e-9, 0],
    list(np.linspace(1, 2, 40)), [1.0] * 12, [4, 4 - 1e-12, 1]])
def test_refined_eigenvectors(values):
    values = sorted(values, reverse=True)
    q, a = matrix(values)
    got, x = whitening.refined(a)
    size = max(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16 * 64
    assert np.abs(got - np.array(values)).max() < 1e-17 * 64 * size
    assert np.abs(a @ x - x * got).max() < 1e-16 * 8 * size
    for k, v in enumerate(values):
        gap = min((abs(v - u) for j, u in enumerate(values) if j != k), default=1)
        if gap > 1e-11 * size:
            assert 1 - abs(float(q[:, k] @ x[:, k])) < 1e-12
    # One precision alone does not get there.
    if len(values) == 40:
        raw = np.linalg.eigh(a.astype(np.float32))[1]
        assert np.abs(raw.T @ raw - np.eye(40)).max() > 1e-8


def slow(rows, k=4):
    """(vec_id, component) -> (n, deviation, whitened, explained), with Python integers and float64 eigenvectors."""
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    own = sorted({tuple(v) for _, v in x})
    n, d = len(own), len(own[0])
    s = [sum(v[j] for v in own) for j in range(d)]
    centred = np.array([[float(Fraction(n * e - t, n)) for e, t in zip(v, s)] for v in own])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x:
        dev = sum((n * c - t) ** 2 for c, t in zip(v, s))
        z = np.array([float(Fraction(n * c - t, n)) for c, t in zip(v, s)]) @ u[:, :k] / np.sqrt(e[:k])
        for j in range(k):
            out[i, j + 1] = (n, dev, z[j], e[j] / np.trace(cov))
    return out


def compare(got, want):
    assert set(got) == set(want)
    sign = {}
    for key, (n, dev, z, share) in want.items():
        g = got[key]
        assert (g["n"], g["deviation"]) == (n, dev) and abs(g["explained"] - share) < 1e-9 and g["identity_error"] < 1e-9
        if abs(z) > 1e-6:
            sign.setdefault(key[1], np.sign(z) * np.sign(g["whitened"]))
            assert abs(sign[key[1]] * g["whitened"] - z) < 1e-8


def test_query(spark):
    pd = pytest.importorskip("pandas")
    if not Path(FOLDER).exists():
        pytest.skip("no shared tables here")
    rows = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    got = {(r["vec_id"], r["component"]): r for r in queries.op13_refined_whitening(spark, FOLDER).collect()}
    compare(got, slow([(i, v.astype(float).tolist()) for i, v in zip(rows.vec_id, rows.embedding)]))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n") for i, v in rows],
                                 "vec_id long, embedding array<float>, deviation_ int, k string").repartition(3)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(np.float32(c)) for c in rng.normal(size=5)]) for k in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [(50, None), (51, [1.0, None, 1.0, 1.0, 1.0]), (52, [nan] + [1.0] * 4), (53, [-inf] + [1.0] * 4), (54, []),
           (55, [1.0, 2.0]), *[(60 + k, good[0][1]) for k in range(40)], (None, good[1][1])]
    found, model = whitening.whitened(frame(spark, good + odd))
    rows = found.collect()
    assert model.n == 30 and len(rows) == 71 and all(len(r["whitened"]) == 4 for r in rows)
    assert {"vec_id", "embedding", "deviation_", "k", "deviation", "whitened"} == set(found.columns)
    want = slow(good + [o for o in odd if o[0] is None or o[0] >= 60])
    first = {r["vec_id"]: r for r in rows}
    for k, r in first.items():
        assert int(r["deviation"]) == want[k, 1][1]
        assert np.allclose(np.abs(r["whitened"]), np.abs([want[k, j][2] for j in (1, 2, 3, 4)]), atol=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_usable(spark, rows):
    found, model = whitening.whitened(frame(spark, rows))
    assert found.count() == 0 and model.n == 0


def test_equal_vectors_have_no_component(spark):
    found, model = whitening.whitened(frame(spark, [(k, [0.5, 1.0]) for k in range(9)]))
    assert model.n == 1 and [r["whitened"] for r in found.collect()] == [[]] * 9 and model.identity_error == 0


def test_large_entries_are_exact(spark):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 5.0]), (3, [1.5e9, 0.0])]
    found, model = whitening.whitened(frame(spark, rows))
    want = slow([(i, [float(np.float32(c)) for c in v]) for i, v in rows], 2)
    assert {r["vec_id"]: int(r["deviation"]) for r in found.collect()} == {i: want[i, 1][1] for i in (1, 2, 3)}


def test_clashing_names(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0 - k * k], "a", "b", 1) for k in range(6)],
                               "vec_id long, embedding array<float>, deviation string, whitened string, _x int")
    found, model = whitening.whitened(df)
    assert found.columns == ["vec_id", "embedding", "deviation", "whitened"] and found.count() == 6 and model.n == 6
