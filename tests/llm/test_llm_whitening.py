from __future__ import annotations

import math

import numpy as np
import pytest
from factweave.llm import whitening as w
from factweave.llm.queries_vectors import op13


def plain_fit(vectors):
    """Plain program: integers, sums and the covariance in Python."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)])
    deviations = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    return x, sums, v, deviations


@pytest.mark.parametrize("n", [1, 63, 64, 65, 500])
def test_scatter_is_exact(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-70, 90, (n, 7))
    x[:, 2] = 5
    x[:, 3] = x[:, 1] * 1000
    x[0, 4] = 1 << 40
    sums, products = w.scatter(x)
    whole = x.astype(object)
    assert sums == whole.sum(axis=0).tolist()
    full = whole.T @ whole
    assert products == [[full[i, j] for j in range(i + 1)] for i in range(7)]


def test_bit_planes_by_hand():
    planes = w.bit_planes(np.array([[5, 0], [2, 1], [7, 0]], np.uint64))
    assert planes.shape == (3, 2, 1)
    assert np.bitwise_count(planes).sum(axis=2).tolist() == [[2, 1], [2, 0], [2, 0]]
    assert np.bitwise_count(planes[0, 0] & planes[1, 0]).sum() == 1  # only 7 has both


@pytest.fixture(scope="module")
def table_of(spark):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) / 20).astype(np.float32)
    rows[100:230] = rows[100]
    return [(i, [float(c) for c in r]) for i, r in enumerate(rows)]


def test_query_equals_plain_program(spark, table_of, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "SLAB", 37)
    odd = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] * 40), (904, [float("inf")] * 40), (905, [1.0] * 39)]
    rows = [*table_of, *odd, (None, table_of[1][1]), table_of[2]]
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "vec_id long, embedding array<float>, n double").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    kept = [r for r in rows if r[0] is None or r[0] < 900]
    x, sums, v, deviations = plain_fit([r[1] for r in kept])
    n = len(kept)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(got) == 32 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    by_id = dict(zip([r[0] for r in kept], deviations, strict=True))
    assert all(r.deviation == by_id[r.vec_id] for r in got)
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[k] for k in range(1, 33)], values[:32] / np.trace(v), rtol=1e-9)
    white = {}
    for r in got:
        white.setdefault(r.vec_id, {})[r.component] = r.whitened
    # Every component is an eigenvector: V times the covariance with x gives back e times it.
    order = [r[0] for r in kept]
    table = np.array([[white[i][k] for k in range(1, 33)] for i in order])
    centred = np.array(x, float) - np.array(sums) / n
    axes = centred.T @ table / n / np.sqrt(values[:32])
    assert np.allclose(v @ axes, axes * values[:32], atol=1e-8) and np.allclose((axes**2).sum(axis=0), 1)
    error = np.abs(table.T @ table / n - np.eye(32)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9 and error < 1e-9


def test_components_without_variance(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 5) * 2, float(i % 3)]) for i in range(60)]
    found, fit, error = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for r in found.collect():
        assert [x is None for x in r["values"]] == [False, False, True, True]
    assert error < 1e-9 and fit.n == 60
    same, _, error = w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    assert {(tuple(r["values"]), int(r.deviation)) for r in same.collect()} == {((None, None), 0)} and error == 0.0


def test_large_entries_stay_exact(spark):
    rows = [(1, [3.0e12, 1.0]), (2, [-3.0e12, 2.0]), (3, [1.0, 5.5])]
    found, fit, error = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    _, sums, v, deviations = plain_fit([r[1] for r in rows])
    assert fit.sums == sums and np.allclose(fit.covariance, v, rtol=1e-12)
    assert {r.id: int(r.deviation) for r in found.collect()} == dict(zip((1, 2, 3), deviations, strict=True))


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13(spark, str(tmp_path))
    assert got.count() == 0 and len(got.columns) == 7
