"""Whitening against numpy's symmetric eigenvalues, and the cases that its docstring states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.whitening import jacobi, whitened

from .util import table

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """Per usable row: exact deviation and whitened entries up to sign; explained shares."""
    usable = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out[i] = deviation, ((np.array(x) - fit.mean(0)) @ v[:, :components]) / np.sqrt(np.maximum(e[:components], 1e-300))
    return n, out, e[:components] / e.sum()


def test_whitening_against_eigenvalues(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=7) * [9, 5, 3, 2, 1, 0.5, 0.2]).tolist()) for k in range(400)]
    rows += [(400 + k, rows[3][1]) for k in range(200)] + [(600, None), (601, [0.0, None] + [0.0] * 5), (602, [float("nan")] + [0.0] * 6), (603, [float("inf")] + [0.0] * 6), (604, [])]
    got = whitened(table(spark, rows, SCHEMA).repartition(5)).collect()
    n, want, share = brute(rows)
    assert n == 400 and len(got) == 4 * 600 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) <= 1e-9 and len({r.identity_error for r in got}) == 1
    for k in range(4):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        assert set(own) == set(want)
        a = np.array([own[i].whitened for i in want])
        b = np.array([want[i][1][k] for i in want])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9
        assert all(abs(r.explained / share[k] - 1) < 1e-9 for r in own.values())
        assert all(own[i].deviation == want[i][0] and own[i].deviation_exact == str(want[i][0]) for i in want)


def test_whitening_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = table(spark, [(k, rng.normal(size=5).tolist()) for k in range(300)], SCHEMA)
    wide = {(r.vec_id, r.component): abs(r.whitened) for r in whitened(df.coalesce(1)).collect()}
    monkeypatch.setattr("gridloom.llm.whitening.FAN_IN", 2)
    for k, r in ((k, r) for k in (3, 7) for r in whitened(df.repartition(k)).collect()):
        assert abs(abs(r.whitened) - wide[r.vec_id, r.component]) < 1e-9, k


def test_whitening_without_variance(spark):
    one = whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitened(table(spark, [(k, [float(k), 0.0, 7.0]) for k in range(5)], SCHEMA)).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    assert sorted(round(abs(r.whitened), 9) for r in line if r.component == 1) == sorted(round(abs(k - 2) / np.sqrt(2), 9) for k in range(5))


def test_whitening_lengths_clashes_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0]), (4, [1e38, 0.0]), (5, [1e15, 0.0])]
    got = whitened(table(spark, rows, SCHEMA).withColumns({c: F.lit("!") for c in ("x", "d", "v", "n", "component", "copies")})).collect()
    assert {r.vec_id for r in got} == {1, 2, 5} and all(r.deviation is None or str(r.deviation) == r.deviation_exact for r in got)
    fit = [[256, 0], [0, 256], [256 * 10**15, 0]]
    x = int(np.floor(256 * float(np.float32(1e15))))
    fit[2][0] = x
    sums = [sum(c) for c in zip(*fit, strict=True)]
    assert {r.deviation_exact for r in got if r.vec_id == 5} == {str(sum((3 * a - s) ** 2 for a, s in zip(fit[2], sums, strict=True)))}
    assert whitened(table(spark, [], SCHEMA)).collect() == [] and whitened(table(spark, [(1, None)], SCHEMA)).collect() == []


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_jacobi(d):
    r = np.linalg.qr(np.random.default_rng(d).normal(size=(3 * d, d)), mode="r")
    sigma, v = jacobi(r)
    assert np.allclose(sigma, np.linalg.svd(r)[1], rtol=1e-12) and np.allclose(v.T @ v, np.eye(d), atol=1e-12)
