"""Exact quantiles by selection, and weighted statistics on every path that takes weights."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.functions import selection
from gridloom.functions.selection import exact_quantiles
from gridloom.operators import climatology, spatial
from gridloom.operators import reduce as core


def weighted_quantile(values, weights, q):
    """Type 7 with the effective number of the weights: the mean of the step function of the running weight
    over a stretch, by its definition."""
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values, float)[order], np.asarray(weights, float)[order]
    total, n = w.sum(), w.sum() ** 2 / (w**2).sum()
    low = q * (n - 1) / n * total
    high, ends = low + total / n, np.cumsum(w)
    return sum(x * max(0.0, min(high, e) - max(low, e - d)) for x, e, d in zip(v, ends, w, strict=True)) / (high - low)


@pytest.mark.parametrize("most", [3, None])
def test_selection_equals_percentile(spark, most):
    rng = np.random.default_rng(1)
    rows = [("one", float(x)) for x in rng.lognormal(0, 4, 700)] + [("ties", float(x)) for x in rng.integers(0, 5, 400)] + [("few", 2.5), ("none", None), ("none", float("nan")), (None, 1.0), (None, 4.0)]
    rows += [("wide", float(x)) for x in 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300)]
    levels = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], F.col("v"), levels, "q", most=most).collect()}
    assert set(got) == {"one", "ties", "few", "none", None, "wide"} and got["none"] == [None] * 6
    for k in got:
        own = [v for g, v in rows if g == k and v is not None and not math.isnan(v)]
        if own:
            assert got[k] == pytest.approx(np.quantile(own, levels), rel=1e-9)
    want = {r.k: r.q for r in df.filter("not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, levels))).alias("q")).collect()}
    assert all(got[k] == pytest.approx(q, rel=1e-9) for k, q in want.items() if q is not None)


def test_selection_of_one_group_of_all_rows_is_bounded(spark, monkeypatch):
    seen = []
    real = selection._in_one_task

    def counted(rows, asks):
        seen.append(rows.groupBy("i").count().agg(F.max("count")).first()[0] or 0)
        return real(rows, asks)

    monkeypatch.setattr(selection, "_in_one_task", counted)
    df = spark.range(30_000).select(F.sin("id").alias("v"), (F.col("id") % 3 + 1).alias("w"))
    (got,) = exact_quantiles(df, [], F.col("v"), [0.25, 0.9], "q", most=200).collect()
    v = np.sin(np.arange(30_000))
    assert got.q == pytest.approx(np.quantile(v, [0.25, 0.9]), rel=1e-12) and len(seen) > 1 and max(seen) <= 200
    (got,) = exact_quantiles(df, [], F.col("v"), [0.25, 0.9], "q", F.col("w"), most=200).collect()
    assert got.q == pytest.approx([weighted_quantile(v, np.arange(30_000) % 3 + 1, q) for q in (0.25, 0.9)], rel=1e-9)


def series(spark, values, weights):
    return Cube.of(spark.createDataFrame([(k, float(v), float(w)) for k, (v, w) in enumerate(zip(values, weights, strict=True))], "x int, v double, w double"), "x", ["v"], ["w"])


def one(cube):
    (row,) = cube.df.collect()
    return row["v"]


@pytest.mark.parametrize(("values", "weights", "want"), [([1, 2, 3], [1, 2, 1], 2.0), ([1, 2, 3], [1, 1, 2], 2.5), ([1, 2, 3], [2, 1, 1], 1.5), ([3, 1, 2], [5, 5, 5], 2.0), ([1, 9], [0, 3], 9.0), ([1, 2], [0, 0], None), ([7], [2], 7.0)])
def test_weighted_median(spark, values, weights, want):
    assert one(core.reduce(series(spark, values, weights), "median", weights="w")) == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_weighted_quantiles(spark, q):
    rng = np.random.default_rng(3)
    values, weights = rng.normal(size=60), rng.random(60) * np.r_[np.ones(59), 40]
    got = one(core.reduce(series(spark, values, weights), "quantile", weights="w", q=q))
    assert got == pytest.approx(weighted_quantile(values, weights, q))
    mirrored = one(core.reduce(series(spark, -values, weights), "quantile", weights="w", q=1 - q))
    assert got == pytest.approx(-mirrored)
    assert one(core.reduce(series(spark, values, np.full(60, 0.3)), "percentile", weights="w", p=100 * q)) == pytest.approx(np.quantile(values, q))


def far_off(spark):
    """Values of 1e9 and 1e9 + 1 in turn: standard deviation 0.5, which sums of squares lose."""
    rows = [(datetime(2020, 1, 1 + k), float(y), 0.0, 1e9 + (k + y) % 2, 1.0 + k % 2) for k in range(20) for y in range(2)]
    return Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double, w double"), ("time", "lat", "lon"), ["v"], ["w"])


@pytest.mark.parametrize(("how", "want"), [("std", 0.5), ("var", 0.25), ("sum_of_squares", 0.25 * 60)])
def test_weighted_deviations_keep_their_digits(spark, how, want):
    cube = far_off(spark)
    square = spatial.features(spark, [("a", spatial.box(-5, -5, 5, 5))], "name")
    whole = {
        "reduce": core.reduce(cube, how, weights="w"),
        "climatology": climatology.reduce(cube.with_df(cube.df.drop("lat", "lon"), dims=("time",)), how, frequency="year", time_dim="time", weights="w"),
        "resample": core.resample(cube, "YE", how, time_dim="time", extra_reduce_dims=("lat", "lon"), weights="w"),
        "spatial": spatial.reduce(cube, square, how, mask_dim="name", extra_reduce_dims="time", weights="w"),
    }
    assert {k: one(c) for k, c in whole.items()} == pytest.approx(dict.fromkeys(whole, want), rel=1e-6)


def test_quantiles_of_large_groups_on_every_path(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST", 7)
    rows = [(datetime(2020 + k % 2, 1 + k % 12, 1 + k // 24), float(k % 3), 0.0, float((k * 37) % 101), None if k % 5 == 0 else float(k)) for k in range(240)]
    cube = Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double, u double"), ("time", "lat", "lon"), ["v", "u"])
    square = spatial.features(spark, [("a", spatial.box(-5, -5, 5, 5))], "name")
    for run in (
        lambda **o: core.reduce(cube, "quantile", dim=("time", "lon"), q=0.3, **o),
        lambda **o: core.reduce(cube, "median", **o),
        lambda **o: core.resample(cube, "3MS", "median", time_dim="time", extra_reduce_dims=("lat", "lon"), **o),
        lambda **o: climatology.reduce(cube, "percentile", frequency="month", time_dim="time", p=80, **o),
        lambda **o: climatology.quantiles(cube, [0.1, 0.6], frequency="month", time_dim="time", **o),
        lambda **o: climatology.quantiles(cube, 0.6, frequency="month", time_dim="time", **o),
        lambda **o: spatial.reduce(cube, square, "median", mask_dim="name", extra_reduce_dims="time", **o),
    ):
        plain, large = run(), run(large_groups=True)
        assert plain.dims == large.dims and plain.vars == large.vars
        a, b = (sorted((tuple(r[d] for d in c.dims), tuple(-1 if r[v] is None else round(r[v], 9) for v in c.vars)) for r in c.df.collect()) for c in (plain, large))
        assert a == b
    with pytest.raises(TypeError):
        core.reduce(cube, "median", large_groups=True, skipna=False)
