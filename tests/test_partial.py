"""User statistics merged from partial states, against whole groups."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.operators import climatology, partial, spatial
from gridloom.operators import reduce as core
from gridloom.operators.partial import Partial


class Kurtosis(Partial):
    """Fourth moment about the mean over the squared variance, by power sums about a fixed point."""

    def init(self):
        return np.zeros(5)

    def update(self, state, values):
        return state + [np.sum((values - 10.0) ** k) for k in range(5)]

    def merge(self, a, b):
        return a + b

    def result(self, state):
        if not state[0]:
            return None
        n, s1, s2, s3, s4 = state
        m = s1 / n
        var = s2 / n - m**2
        return float((s4 / n - 4 * m * s3 / n + 6 * m**2 * s2 / n - 3 * m**4) / var**2) if var > 1e-12 else None


def plain(values):
    v = np.array([x for x in values if x is not None], float)
    return None if len(v) == 0 or v.var() < 1e-12 else float(np.mean((v - v.mean()) ** 4) / v.var() ** 2)


@pytest.mark.parametrize("cells", [7, 1 << 18])
def test_partial_of_groups(spark, monkeypatch, cells):
    monkeypatch.setattr(partial, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][k % 3], k, None if k % 11 == 0 else float(rng.normal(10, 3)), float(k % 5)) for k in range(300)] + [("empty", 1000 + k, None, 1.0) for k in range(4)]
    cube = Cube.of(spark.createDataFrame(rows, "g string, k int, v double, u double").repartition(5), ("g", "k"))
    out = core.reduce(cube, Kurtosis(), dim="k", how_label="kurtosis")
    assert out.dims == ("g",) and out.vars == ("v_kurtosis", "u_kurtosis")
    for r in out.df.collect():
        for v, i in (("v_kurtosis", 2), ("u_kurtosis", 3)):
            want = plain([x[i] for x in rows if x[0] == r.g])
            assert r[v] == (None if want is None else pytest.approx(want))
    assert {r.g for r in out.df.collect()} == {"a", "b", None, "empty"}
    (whole,) = core.reduce(cube, Kurtosis()).df.collect()
    assert whole.v == pytest.approx(plain([x[2] for x in rows]))
    with pytest.raises(TypeError):
        core.reduce(cube, Kurtosis(), ddof=1)


def test_one_group_of_all_rows_has_a_state_for_each_run_of_cells(spark, monkeypatch):
    monkeypatch.setattr(partial, "CELLS", 1000)
    cube = Cube.of(spark.range(0, 50_000, 1, 8).select(F.col("id").alias("k"), F.sin("id").alias("v")), "k")
    (row,) = core.reduce(cube, Kurtosis()).df.collect()
    assert row.v == pytest.approx(plain(np.sin(np.arange(50_000))))


def test_partial_in_resample_climatology_and_features(spark):
    rows = [(datetime(2020 + k % 2, 1 + k % 12, 1 + k // 24), float(k % 3), 0.0, float(k * 7 % 31)) for k in range(240)]
    cube = Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double"), ("time", "lat", "lon"), ["v"])
    years = core.resample(cube, "YE", Kurtosis(), time_dim="time", extra_reduce_dims=("lat", "lon")).df.collect()
    assert {r.time.year: pytest.approx(r.v) for r in years} == {y: plain([v for t, _, _, v in rows if t.year == y]) for y in (2020, 2021)}
    months = climatology.reduce(cube.with_df(cube.df.drop("lat", "lon"), dims=("time",)), Kurtosis(), frequency="month", time_dim="time").df.collect()
    assert {r.month: pytest.approx(r.v) for r in months} == {m: plain([v for t, _, _, v in rows if t.month == m]) for m in range(1, 13)}
    regions = spatial.features(spark, [("low", spatial.box(-1, -1, 1, 1.5)), ("none", spatial.box(50, 50, 60, 60))], "name")
    found = {r.name: r.v for r in spatial.reduce(cube, regions, Kurtosis(), mask_dim="name", extra_reduce_dims="time").df.collect()}
    assert found == {"low": pytest.approx(plain([v for _, y, _, v in rows if y < 1.5])), "none": None}


def test_masks_named_by_values(spark):
    cells = [(float(y), float(x), float(10 * y + x)) for y in range(4) for x in range(4)]
    cube = Cube.of(spark.createDataFrame(cells, "lat double, lon double, v double"), ("lat", "lon"))
    regions = spatial.features(spark, [("p", spatial.box(-0.5, -0.5, 1.5, 1.5)), ("q", spatial.box(1.5, 1.5, 9, 9))], "name").coalesce(1)
    got = {r.zone: r.v for r in spatial.reduce(cube, regions, "max", mask_dim={"zone": ["first", "second"]}).df.collect()}
    assert got == {"first": 11.0, "second": 33.0}
