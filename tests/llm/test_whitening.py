"""Whitening against numpy's eigenvectors of the whole covariance."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)


def check(got, vectors, k, scale=1024.0):
    x = np.floor(scale * np.array(list(vectors.values())))
    n, c = len(x), x - x.sum(axis=0) / len(x)
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    want = c @ turn / np.sqrt(values)
    at = {(r.vec_id, r.component): r for r in got}
    assert len(at) == len(got) == n * k
    mine = np.array([[at[i, j + 1].whitened for j in range(k)] for i in vectors])
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-8
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert np.allclose([at[next(iter(vectors)), j + 1].explained for j in range(k)], values / np.trace(c.T @ c / n), rtol=1e-9)
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for i, row in zip(vectors, x)}
    assert all(r.deviation == exact[r.vec_id] for r in got)


@pytest.mark.parametrize("fan", [2, 64])
def test_flat_spectrum_grows(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(24).tolist() for i in range(300)}
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 22), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [1.0, 2.0])]
    df = frame(spark, [*vectors.items(), *bad])
    assert whitening.fit(df, 5).grown
    check(whitening.whiten(df, 5).collect(), vectors, 5)


def test_falling_spectrum_converges_in_the_basis(spark):
    rng = np.random.default_rng(2)
    vectors = {i: v.tolist() for i, v in enumerate(rng.standard_normal((500, 40)) * 0.3 ** np.arange(40))}
    df = frame(spark, list(vectors.items()))
    fitted = whitening.fit(df, 3, 1e6)
    assert not fitted.grown
    check(whitening.whiten(df, 3, 1e6).collect(), vectors, 3, 1e6)


def test_few_rows_equal_rows_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 4)).count() == 0
    # three rows span two dimensions; repeated and null ids are rows of their own
    got = whitening.whiten(frame(spark, [(1, [0.0, 0.0, 1.0]), (1, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0])])).collect()
    assert sorted(str((r.vec_id, r.component)) for r in got) == sorted(str(x) for x in [(1, 1), (1, 2), (1, 1), (1, 2), (None, 1), (None, 2)])


def test_deviations_beyond_a_long(spark):
    got = whitening.whiten(frame(spark, [(1, [1e15, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]), 1).collect()
    assert {r.deviation for r in got} == {None}
