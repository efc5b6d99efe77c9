import math

import numpy as np
import pytest

from certalog.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def covariance(rows):
    """Exact integers, then doubles."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(d)]
    y = [[n * v[k] - sums[k] for k in range(d)] for v in x]
    cov = np.array([[float(sum(v[i] * v[j] for v in y)) / n**3 for j in range(d)] for i in range(d)])
    return cov, y, n


def held(got, rows, most=32):
    """The result against numpy's symmetric eigenproblem and exact sums."""
    cov, y, n = covariance([v for _, v in rows])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) * k and set(by) == {d for d, _ in rows}
    sign = {}
    for (d, _), exact in zip(rows, y):
        for c in range(1, k + 1):
            r = by[d][c]
            assert r.n == n and r.deviation == sum(e * e for e in exact) and r.identity_error <= 1e-4
            assert r.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-6)
            want = float(np.array(exact, dtype=float) / n @ axes[:, c - 1] / math.sqrt(values[c - 1]))
            if abs(want) > 1e-3:
                sign.setdefault(c, math.copysign(1, want) * math.copysign(1, r.whitened))
            assert r.whitened * sign.get(c, 1) == pytest.approx(want, abs=1e-6)
    return values[:k]


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    held(whitening.op13_whitening(spark, "/root/testdata/sf0.001").collect(), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("kind", ["few", "spread", "pairs", "offset", "low rank", "one"])
def test_spectra(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, d = {"few": (9, 5), "one": (60, 1)}.get(kind, (150, 40))
    v = rng.standard_normal((n, d))
    if kind == "spread":
        v *= 1.5 ** -np.arange(d) * 1e3
    if kind == "offset":
        v += 1e6
    if kind == "low rank":
        v = np.repeat(v[:, :6], 7, axis=1)[:, :d]
    if kind == "pairs":
        v = np.concatenate([v, v[:, ::-1]]) * 50
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    held(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


@pytest.mark.parametrize("values", [[5.0] * 6 + [1.0] * 6, list(np.geomspace(1, 1e-11, 30)), [7, 7, 7 - 1e-9, 3, 0, 0], [1.0], list(np.linspace(1, 1.001, 50)), [0.0, 0.0]])
@pytest.mark.parametrize("most", [3, 32])
def test_components_miss_none(values, most):
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values)) @ q.T
    got, axes = whitening.components((v + v.T) / 2, most)
    want = sorted((x for x in values if x > 0), reverse=True)[:most]
    assert got.tolist() == pytest.approx(want, rel=1e-3, abs=1e-14)
    assert np.abs(axes.T @ axes - np.eye(len(want))).max(initial=0) < 1e-7
    assert np.abs(v @ axes - axes * got).max(initial=0) <= 1e-12 * max(values)


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((20, 20))
    v = v @ v.T
    t, values = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
    for shift in [-1, 0.0, *((values[1:] + values[:-1]) / 2), 1e9]:
        assert whitening.inertia(t, shift) == (values > shift).sum()


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, rng.standard_normal(4).tolist()) for k in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [math.nan, 1.0, 1.0, 1.0]), (103, [math.inf, 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(d, v, 1, 2.0) for d, v in good + odd], SCHEMA + ", component int, x double")
    got = whitening.whiten(df).collect()
    held(got, good)
    twice = whitening.whiten(spark.createDataFrame(good * 2 + [(None, good[0][1])], SCHEMA)).collect()
    assert len(twice) == 61 * 4 and twice[0].n == 61
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], odd[:5]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(k, [float(k) * 1e12, 1.0 * (k % 3)]) for k in range(8)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    _, y, _ = covariance([v for _, v in rows])
    assert {r.vec_id: r.deviation for r in got} == {k: d if (d := sum(e * e for e in x)) < 1 << 63 else None for (k, _), x in zip(rows, y)}
