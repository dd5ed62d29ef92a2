"""Rolling windows along long axes and over blocks, against plain loops."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.operators import reduce as core

STATISTICS = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "std": np.std, "var": np.var, "count": len, "prod": np.prod, "median": np.median}


def windows(cells, sizes, center, least):
    """For each cell the valid values of its block: labels are those that any cell has."""
    axes = [sorted({k[d] for k in cells}) for d in range(len(sizes))]
    at = [{x: i for i, x in enumerate(a)} for a in axes]
    valid = {tuple(at[d][x] for d, x in enumerate(k)): v for k, v in cells.items() if v is not None}
    for k in cells:
        i = [at[d][x] for d, x in enumerate(k)]
        ranges = [range(j - (n // 2 if center else n - 1), j + ((n - 1) // 2 if center else 0) + 1) for j, n in zip(i, sizes, strict=True)]
        own = [(place, valid[place]) for place in np.ndindex(*map(len, ranges)) for place in [tuple(r[p] for r, p in zip(ranges, place, strict=True))] if place in valid]
        yield k, own if len(own) >= least else None, [r[0] for r in ranges]


@pytest.mark.parametrize(("piece", "center"), [(3, False), (5, True), (1 << 16, False)])
def test_one_long_series(spark, monkeypatch, piece, center):
    monkeypatch.setattr(core, "PIECE", piece)
    monkeypatch.setattr(core, "INTERVALS", 4)
    rng = random.Random(1)
    days = [datetime(2020, 1, 1) + timedelta(days=k) for k in range(60) if k % 11]
    cells = {(t,): None if rng.random() < 0.15 else rng.uniform(0.5, 2) for t in days}
    cube = Cube.of(spark.createDataFrame([(*k, v) for k, v in cells.items()], "time timestamp_ntz, v double").repartition(3), "time")
    for how in STATISTICS:
        got = {(r.time,): r.v for r in core.rolling_reduce(cube, how, time=7, center=center, min_periods=4).df.collect()}
        want = {k: None if own is None else float(STATISTICS[how]([v for _, v in own])) for k, own, _ in windows(cells, [7], center, 4)}
        assert set(got) == set(want) and all(got[k] == (None if w is None else pytest.approx(w)) for k, w in want.items()), how
    for how, best in (("argmin", min), ("argmax", max)):
        got = {(r.time,): r.v for r in core.rolling_reduce(cube, how, time=7, center=center, min_periods=4).df.collect()}
        assert got == {k: None if own is None else best(own, key=lambda x: x[1])[0][0] - low[0] for k, own, low in windows(cells, [7], center, 4)}
    got = {(r.time,): r.v for r in core.rolling_reduce(cube, lambda x, axis=None: np.nansum(x, axis=axis), time=7, center=center, min_periods=4).df.collect()}
    assert all(got[k] == (None if own is None else pytest.approx(sum(v for _, v in own))) for k, own, _ in windows(cells, [7], center, 4))


def test_a_long_series_uses_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(core, "PIECE", 100)
    cube = Cube.of(spark.range(5000).select(F.col("id").alias("x"), F.col("id").cast("double").alias("v")), "x")
    rows = core.rolling_reduce(cube, "mean", x=10).df
    assert rows.count() == 5000 and rows.filter("v is null").count() == 9 and rows.filter("x >= 9 and v <> x - 4.5").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "rangebetween" in line.lower() or "RangeFrame" in line]
    assert windows and all("__piece" in line for line in windows if "__i_x" in line)


@pytest.mark.parametrize(("piece", "center"), [(2, True), (1 << 16, False)])
def test_blocks_with_absent_rows(spark, monkeypatch, piece, center):
    monkeypatch.setattr(core, "PIECE", piece)
    rng = random.Random(2)
    cells = {(x, y): None if rng.random() < 0.1 else 1e6 + rng.uniform(0, 9) for x in range(9) for y in range(7) if rng.random() < 0.6}
    cube = Cube.of(spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, v double").repartition(3), ("x", "y"))
    for how in ("mean", "sum", "min", "max", "std", "var", "count", "median"):
        got = {(r.x, r.y): r.v for r in core.rolling_reduce(cube, how, dim={"x": 3, "y": 2}, center=center, min_periods=2).df.collect()}
        want = {k: None if own is None else float(STATISTICS[how]([v for _, v in own])) for k, own, _ in windows(cells, [3, 2], center, 2)}
        assert set(got) == set(want)
        assert all(got[k] == (None if w is None else pytest.approx(w, rel=1e-6, abs=1e-6)) for k, w in want.items()), how
    strict = core.rolling_reduce(cube, "numpy.mean", dim={"x": 2, "y": 2}).df
    want = {k: None if own is None else float(np.mean([v for _, v in own])) for k, own, _ in windows(cells, [2, 2], False, 4)}
    assert {(r.x, r.y): r.v for r in strict.collect()} == {k: None if w is None else pytest.approx(w) for k, w in want.items()}


def test_blocks_over_three_dimensions_collect_nothing(spark):
    cells = {(x, y, z): float(x * y + z) for x in range(4) for y in range(4) for z in range(3)}
    cube = Cube.of(spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, z int, v double"), ("x", "y", "z"))
    for how in ("mean", "max"):
        rows = core.rolling_reduce(cube, how, dim={"x": 2, "y": 3, "z": 2}).df
        assert "collect_list" not in rows._jdf.queryExecution().toString()
        want = {k: None if own is None else float(STATISTICS[how]([v for _, v in own])) for k, own, _ in windows(cells, [2, 3, 2], False, 12)}
        assert {(r.x, r.y, r.z): r.v for r in rows.collect()} == {k: None if w is None else pytest.approx(w) for k, w in want.items()}


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_running_sums_and_products_along_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(core, "PIECE", piece)
    rng = random.Random(4)
    cells = {(g, x): None if rng.random() < 0.2 else rng.uniform(0.8, 1.2) for g in ("a", "b", None) for x in range(0, 60, 2) if rng.random() < 0.8}
    cube = Cube.of(spark.createDataFrame([(*k, v) for k, v in cells.items()], "g string, x int, v double").repartition(3), ("g", "x"))
    for how, f in (("cumsum", np.cumsum), ("cumprod", np.cumprod)):
        got = {(r.g, r.x): r.v for r in core.reduce(cube, how, dim="x").df.collect()}
        for g in ("a", "b", None):
            own = sorted(k for k in cells if k[0] == g)
            want = f([(0 if how == "cumsum" else 1) if cells[k] is None else cells[k] for k in own])
            assert [got[k] for k in own] == pytest.approx(want.tolist())
    (alone,) = {tuple(core.reduce(Cube.of(spark.range(50).select("id", F.lit(1.0).alias("v")), "id"), "cumsum", dim="id").df.agg(F.sum("v"), F.max("v")).first())}
    assert alone == (1275.0, 50.0)


def test_rolling_drops_missing_labels(spark):
    cube = Cube.of(spark.createDataFrame([(k, g, None if (k, g) == (4, "b") else float(k)) for k in range(8) for g in "ab"], "x int, g string, v double"), ("x", "g"))
    assert sorted({r.x for r in core.rolling_reduce(cube, "mean", x=3, how_dropna="any").df.collect()}) == [2, 3, 7]
    assert sorted({r.x for r in core.rolling_reduce(cube, "mean", x=3, how_dropna="all").df.collect()}) == [2, 3, 4, 5, 6, 7]
    assert len(core.rolling_reduce(cube, "mean", x=3, how_dropna="None").df.collect()) == 16


@pytest.mark.parametrize("kind", ["double", "date", "timestamp_ntz", "timestamp", "decimal(10,3)", "int", "string"])
def test_dense_index(spark, monkeypatch, kind):
    monkeypatch.setattr(core, "INTERVALS", 5)
    numbers = sorted({0, 1, 5, 6, 7, 100, 101, 5000})
    at = F.col("n").cast("int") if kind in ("int",) else F.date_add(F.lit("2000-01-01"), F.col("n").cast("int")).cast(kind) if kind in ("date", "timestamp_ntz", "timestamp") else F.lpad(F.col("n").cast("string"), 5, "0") if kind == "string" else F.col("n").cast(kind)
    df = spark.createDataFrame([(n,) for n in numbers * 2], "n long").select(at.alias("x"))
    rows = core.dense_index(df, "x").orderBy("x").collect()
    assert [r["__index"] for r in rows] == list(range(8)) and [r["__previous"] for r in rows] == [None, *[r.x for r in rows][:-1]]
    one = core.dense_index(df.limit(1), "x").collect()
    assert [r["__index"] for r in one] == [0] and one[0]["__previous"] is None
    assert core.dense_index(df.filter("false"), "x").count() == 0 and math.isfinite(1)
