"""Whitening against numpy's eigenvectors and exact integers, with nulls, repeated rows, constant and equal dimensions."""

import math
import random

import numpy as np
import pytest

from codestrata.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], SCHEMA)


def usable(rows):
    longest = max((len(v) for _, v in rows if v is not None), default=0)
    return [(i, v) for i, v in rows if v is not None and len(v) == longest and all(c is not None and math.isfinite(c) for c in v)]


def sample(n=300, dims=40, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, dims)) @ np.diag(np.linspace(3, 0.4, dims)) + rng.normal(size=dims) * 50
    return [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(values)]


def plain(rows):
    x = [[math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v] for _, v in usable(rows)]
    n, total = len(x), [sum(c) for c in zip(*x)]
    far = [sum((n * a - s) ** 2 for a, s in zip(r, total)) for r in x]
    y = np.array([[(n * a - s) / n for a, s in zip(r, total)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return far, values[::-1], vectors[:, ::-1], y


@pytest.mark.parametrize("dims", [40, 5])
def test_components_and_whitened_rows(spark, dims, tmp_path):
    rows = sample(dims=dims)
    rows += [rows[7], rows[7], (None, rows[8][1]), (900, None), (901, [float("nan")] * dims), (902, [None] + [1.0] * (dims - 1))]
    rows += [(903, []), (904, [float("inf")] * dims), (905, [1.0] * (dims - 1)), (906, [3e38] * dims)]
    expected_rows = [r for r in usable(rows) if r[0] != 906]
    far, values, vectors, y = plain(expected_rows)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = W.query(spark, str(tmp_path)).collect()
    width = min(32, dims)
    assert len(found) == width * len(expected_rows)
    by_id: dict = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
        assert r.n == len(expected_rows) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    signs = None
    for (i, _), d, row in zip(expected_rows, far, y):
        own = sorted(by_id[i], key=lambda r: r.component)
        assert {r.deviation for r in own} == {d}
        got = np.array([r.whitened for r in own]).reshape(width, -1)[:, 0]
        want = row @ vectors[:, :width] / np.sqrt(values[:width])
        signs = np.sign(got * want) if signs is None else signs
        assert np.allclose(got, want * signs, rtol=1e-7, atol=1e-7)


def test_less_rank_than_components(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(50):
        a, b = rng.uniform(-9, 9), rng.uniform(-2, 2)
        rows.append((i, [a, a, 5.0, b, a]))  # three equal dimensions and a constant one
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = W.query(spark, str(tmp_path)).collect()
    assert {r.component for r in found} == {1, 2} and found[0].identity_error < 1e-9
    model = W.fit(table(spark, rows[:1]))
    assert len(model.values) == 0 and W.whitened(table(spark, rows[:1]), model).first().whitened == []


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [float("nan")])]])
def test_nothing_to_fit(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert W.query(spark, str(tmp_path)).collect() == []


def test_factorisation():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(90, 30)) @ np.diag(np.logspace(0, -5, 30))
    v = a.T @ a
    factor = W.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, rtol=0, atol=1e-14 * v.max())
    values, vectors = W.one_sided_jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(30), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-13 * v.max())


def test_large_numbers_stay_exact():
    x = np.array([[2**50, 1], [2**50 + 1, -(2**49)], [3, 5]], np.int64)
    total = W.exact_sums(x)
    assert total == [2**51 + 4, 6 - 2**49]
    mean = W.Mean(3, tuple(total))
    assert mean.deviations(x) == [sum((3 * a - s) ** 2 for a, s in zip(r, total)) for r in x.tolist()]
