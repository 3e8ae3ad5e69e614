"""Whitening against a dense eigen solver; the splitting of matrices with equal, no and zero eigenvalues."""

import math

import numpy as np
import pytest

from factlake.llm.whitening import eigen, polar, split, whiten

SCHEMA = "vec_id long, embedding array<float>, n long, whitened string, component int"


def brute(rows, k):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in rows]
    dim = max(set(lengths), key=lambda x: (lengths.count(x), x))
    rows = [(i, v) for i, v in rows if len(v) == dim]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return [i for i, _ in rows], n, deviation, centred, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(v)


def check(spark, rows, k=32):
    df = spark.createDataFrame([(i, v, 5, "x", 7) for i, v in rows], SCHEMA).repartition(3)
    got = whiten(df, k).collect()
    ids, n, deviation, centred, values, vectors, trace = brute(rows, k)
    k = len(values)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got if r["component"] == 1) == sorted((str(i), d) for i, d in zip(ids, deviation, strict=True))
    for c in range(k):
        own = [r for r in got if r["component"] == c + 1]
        assert all(abs(r["explained"] - values[c] / trace) < 1e-9 for r in own)
        gaps = np.abs(np.delete(values, c) - values[c])
        if values[c] > 1e-9 and (k == 1 or gaps.min() > 1e-3 * values[0]) and k == centred.shape[1]:
            want = sorted(zip(map(str, ids), np.abs(centred @ vectors[:, c]) / math.sqrt(values[c]), strict=True))
            have = sorted((str(r["vec_id"]), abs(r["whitened"])) for r in own)
            assert np.allclose([h[1] for h in have], [w[1] for w in want], atol=1e-8)
            assert abs(sum(r["whitened"] for r in own)) < 1e-6 * n
    return {r["identity_error"] for r in got}


def test_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    scale = np.array([3.0, 2.0, 1.5, 1.0, 0.5, 0.2])
    rows = [(i, (rng.standard_normal(6) * scale + 4).astype(float).tolist()) for i in range(120)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (300, None), (301, [1.0] * 5 + [None]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, [1.0, 2.0])]
    (error,) = check(spark, rows)
    assert error < 1e-9
    (error,) = check(spark, rows, 2)
    assert error < 1e-9


def test_without_variance(spark):
    assert check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 3.0])]) == {1.0}
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"]) for r in got] == [(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 0)]


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.isEmpty()


def test_large_entries_stay_exact(spark):
    rows = [(k, [1e12 * k, float(k % 3), 3e15 + k]) for k in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((7 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert {r["vec_id"]: int(r["deviation"]) for r in whiten(df).collect()} == want
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_spectral_division():
    rng = np.random.default_rng(1)
    for a in (np.diag([3.0, 2, 2, 2, 1, 1]), np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]])), np.zeros((3, 3)), np.ones((5, 5)), np.cov(rng.standard_normal((40, 500)))):
        values, vectors = eigen(a, len(a))
        want = np.sort(np.linalg.eigvalsh(a))[::-1]
        top = max(want[0], 1.0)
        assert np.abs(values - want).max() < 1e-13 * top and np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-13 * top
    a = np.cov(rng.standard_normal((12, 50)))
    u = polar(a - np.median(np.diag(a)) * np.eye(12))
    assert np.abs(u @ u - np.eye(12)).max() < 1e-13
    left, right = split(a)
    assert np.linalg.eigvalsh(left.T @ a @ left).min() > np.linalg.eigvalsh(right.T @ a @ right).max()
