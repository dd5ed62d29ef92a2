"""Exact values on small grids and series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.detect import evenly_spaced, find_axis, infer_frequency, spatial_info
from gridloom.functions import statistics as st
from gridloom.functions.periods import Period, bins, datetime_pattern, parse_timedelta, season_order, span_name
from gridloom.operators import climatology, ensemble, rates, spatial, temporal
from gridloom.operators import reduce as core
from gridloom.operators.spatial import box, features

NAN = float("nan")


def series(spark, start, step, values, name="var", time="time", meta=None):
    rows = [(start + k * step if isinstance(step, timedelta) else step(start, k), float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"{time} timestamp_ntz, {name} double")
    return Cube.of(df.withMetadata(name, meta) if meta else df, time, [name])


def months(start, k):
    m = start.month - 1 + k
    return start.replace(year=start.year + m // 12, month=m % 12 + 1)


def column(cube, name, order=None):
    df = cube.df.orderBy(*(order or cube.dims)) if (order or cube.dims) else cube.df
    return [r[name] for r in df.select(name).collect()]


@pytest.fixture(scope="module")
def nan2x2(spark):
    return Cube.of(spark.createDataFrame([(0, 0, 1.0), (0, 1, NAN), (1, 0, 1.0), (1, 1, 2.0)], "x int, y int, v double"), ("x", "y"))


@pytest.fixture(scope="module")
def grid5(spark):
    return Cube.of(spark.createDataFrame([(x, y, 5 * x + y) for x in range(5) for y in range(5)], "x int, y int, test long"), ("x", "y"))


@pytest.mark.parametrize("how, want", [("mean", 4 / 3), ("average", 4 / 3), ("nanmean", 4 / 3), ("std", math.sqrt(2) / 3), ("stddev", math.sqrt(2) / 3), ("sum", 4), ("nansum", 4), ("max", 2), ("min", 1), ("median", 1), ("count", 3), ("var", 2 / 9), ("numpy.nanmean", 4 / 3), ("prod", 2)])
def test_reduce_skips_missing(nan2x2, how, want):
    assert column(core.reduce(nan2x2, how), "v") == [pytest.approx(want)]


def test_reduce_strict_propagates(nan2x2):
    assert column(core.reduce(nan2x2, "numpy.mean"), "v") == [None]


def test_reduce_label_and_dim(nan2x2):
    out = core.reduce(nan2x2, "mean", dim="y", how_label="h")
    assert out.vars == ("v_h",) and out.dims == ("x",) and column(out, "v_h") == [1.0, 1.5]


def test_reduce_callable(nan2x2):
    assert column(core.reduce(nan2x2, lambda x, axis=None: np.nanmax(x, axis=axis) * 10), "v") == [20.0]


def test_reduce_unknown(nan2x2):
    with pytest.raises(ValueError):
        core.reduce(nan2x2, "no_such_thing")
    with pytest.raises(ValueError):
        core.reduce(nan2x2, "mean", dim="nope")


def test_weights_by_table(spark, nan2x2):
    w = spark.createDataFrame([(0, 1.0), (1, 2.0)], "x int, w double")
    assert column(core.reduce(nan2x2, "mean", weights=w), "v") == [pytest.approx(1.4)]
    assert column(core.reduce(nan2x2, "std", weights=w), "v") == [pytest.approx(math.sqrt((1 * 0.16 + 2 * 0.16 + 2 * 0.36) / 5))]


def test_latitude_weights(spark):
    cube = Cube.of(spark.createDataFrame([(float(y), 1) for y in (-90, -60, 0, 60, 90)], "latitude double, v long"), "latitude")
    got = [r[0] for r in cube.df.orderBy("latitude").select(st.latitude_weight(F.col("latitude"))).collect()]
    assert got == pytest.approx([0, 0.5, 1, 0.5, 0])
    with pytest.raises(NotImplementedError):
        core.reduce(cube, weights="longitude")


@pytest.mark.parametrize("how, want", [("mean", 2.5), ("std", 2.5), ("sum", 5), ("max", 5), ("min", 0), ("median", 2.5)])
def test_rolling_centred(grid5, how, want):
    out = core.rolling_reduce(grid5, how, x=2, center=True, how_dropna="any")
    rows = out.df.orderBy("x", "y").collect()
    assert len(rows) == 20 and rows[0]["test"] == want


def test_rolling_over_two_dims(grid5):
    full = {(r.x, r.y): r.test for r in core.rolling_reduce(grid5, "mean", dim={"x": 2, "y": 2}).df.collect()}
    assert full[0, 0] is None and full[1, 1] == 3.0 and full[4, 4] == (18 + 19 + 23 + 24) / 4
    for how, f in (("median", np.median), ("std", np.std), ("max", np.max), ("sum", np.sum)):
        one = {(r.x, r.y): r.test for r in core.rolling_reduce(grid5, how, dim={"x": 2, "y": 2}).df.collect()}
        assert one[1, 1] == pytest.approx(f([0, 1, 5, 6]))


def test_rolling_absent_row_is_missing(spark):
    days = [datetime(2020, 1, d) for d in (1, 2, 3, 4)]
    rows = [("a", d, 1.0) for d in days] + [("b", d, 1.0) for d in days if d.day != 2]
    cube = Cube.of(spark.createDataFrame(rows, "k string, time timestamp_ntz, v double"), ("k", "time"))
    got = {(r.k, r.time.day): r.v for r in temporal.rolling_reduce(cube, 2, "sum").df.collect()}
    assert got["a", 2] == 2.0 and got["b", 3] is None and got["b", 4] == 2.0


def test_resample_two_days(spark):
    cube = series(spark, datetime(2024, 1, 1), timedelta(days=1), [1, 2, 3, 4], "test")
    assert column(core.resample(cube, "2D", "mean"), "test") == [1.5, 3.5]
    assert column(core.resample(cube, "2D", "sum"), "test") == [3, 7]


def test_resample_joint_extra_dims(spark):
    v = [[1, 2], [3, NAN], [5, 6], [7, 8]]
    rows = [(datetime(2024, 1, 1 + t), x, float(v[t][x])) for t in range(4) for x in range(2)]
    cube = Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, x int, test double"), ("time", "x"))
    assert column(core.resample(cube, "2D", "mean", extra_reduce_dims="x"), "test") == [2.0, 6.5]


@pytest.mark.parametrize("freq, n", [("D", 90), ("dayofyear", 90), ("5D", 18), ("weekofyear", 14), ("day", 90), ("MS", 3), ("ME", 3), ("3MS", 1), ("month", 3), ("YE", 1), ("year", 1)])
def test_resample_lengths(spark, freq, n):
    cube = series(spark, datetime(2020, 1, 1), timedelta(hours=1), range(90 * 24))
    assert temporal.reduce(cube, frequency=freq).df.count() == n


@pytest.mark.parametrize("freq", ["3D", "W", "2W", "MS", "ME", "2MS", "2ME", "QS", "QE", "YE", "YS", "7h", "90min"])
def test_resample_labels_like_pandas(spark, freq):
    hours = 24 * 200 if not freq.endswith(("h", "min")) else 50
    s = pd.Series(np.arange(hours, dtype=float), pd.date_range("2020-01-03 05:00", periods=hours, freq="h"))
    want = s.resample(freq).mean()
    got = core.resample(series(spark, datetime(2020, 1, 3, 5), timedelta(hours=1), s), freq, "mean").df.orderBy("time").collect()
    assert [r.time for r in got] == list(want.index.to_pydatetime()) and [r["var"] for r in got] == pytest.approx(list(want))


def test_fill_gaps(spark):
    cube = Cube.of(spark.createDataFrame([(datetime(2020, 1, 1), 1.0), (datetime(2020, 1, 4), 2.0)], "time timestamp_ntz, v double"), "time")
    assert column(core.resample(cube, "D", "mean", fill_gaps=True), "v") == [1.0, None, None, 2.0]


def test_unknown_frequency():
    with pytest.raises(ValueError):
        Period.parse("fortnight")


def test_daily_and_monthly(spark):
    hours = series(spark, datetime(2020, 1, 1), timedelta(hours=1), range(48))
    assert column(temporal.daily_mean(hours), "var") == [11.5, 35.5]
    days = series(spark, datetime(2020, 1, 1), timedelta(days=1), range(60))
    assert column(temporal.monthly_mean(days), "var") == [15.0, 45.0]
    assert column(temporal.daily_mean(hours, how="max"), "var") == [11.5, 35.5]


def test_daily_by_coordinate(spark):
    rows = [(datetime(2020, 1, 1), h, datetime(2020, 1, 1) + timedelta(hours=h), float(h)) for h in range(0, 48, 6)]
    cube = Cube.of(spark.createDataFrame(rows, "forecast_reference_time timestamp_ntz, step int, valid_time timestamp_ntz, v double"), ("forecast_reference_time", "step"), ["v"], ("valid_time",))
    assert column(temporal.daily_mean(cube, time_dim="valid_time"), "v", ["valid_time"]) == [9.0, 33.0]


def test_daily_of_spans(spark):
    cube = Cube.of(spark.createDataFrame([(h * 3_600_000_000, float(h)) for h in range(48)], "time long, v double"), "time")
    out = temporal.daily_mean(cube)
    assert column(out, "time") == [0, 1] and column(out, "v") == [11.5, 35.5]
    with pytest.raises(TypeError):
        temporal.monthly_mean(cube)


def test_shift_and_trim(spark):
    cube = series(spark, datetime(2000, 1, 1), timedelta(days=1), [1, 2, 3])
    out = temporal.daily_mean(cube, time_shift="1 day")
    assert column(out, "time")[0] == datetime(2000, 1, 2)
    out = temporal.daily_mean(cube, time_shift={"days": 1}, remove_partial_periods=True)
    assert column(out, "time") == [datetime(2000, 1, 3)]


def test_standardise_time(spark):
    cube = series(spark, datetime(2020, 1, 1), months, range(5))
    assert {d.day for d in column(temporal.standardise_time(cube, "%Y-%m-15"), "time")} == {15}
    assert column(temporal.standardise_time(cube), "time") == column(cube, "time")
    assert datetime_pattern("%Y-%m-15") == "yyyy-MM-'15'"


@pytest.mark.parametrize("span, name", [(timedelta(days=1), "days"), (timedelta(hours=3), "(3 hours)"), (timedelta(seconds=90), "(1.5 minutes)"), (timedelta(seconds=1), "seconds"), (timedelta(milliseconds=5), "5.0 milliseconds"), (timedelta(hours=-36), "(-1.5 days)"), (timedelta(seconds=10_000), "(2.777778 hours)")])
def test_span_names(span, name):
    assert span_name(span) == name


@pytest.mark.parametrize("text, span", [("12h", timedelta(hours=12)), ("1 day", timedelta(days=1)), ("-90 minutes", timedelta(minutes=-90)), ({"hours": 2}, timedelta(hours=2))])
def test_parse_timedelta(text, span):
    assert parse_timedelta(text) == span


@pytest.fixture(scope="module")
def cycle(spark):
    return series(spark, datetime(2000, 1, 1), months, list(range(1, 13)) * 5)


def test_climatology(spark, cycle):
    assert column(climatology.monthly_mean(cycle), "var") == list(range(1, 13))
    assert climatology.reduce(cycle).dims == ()
    days = series(spark, datetime(2001, 1, 1), timedelta(days=1), np.random.default_rng(42).random(365 * 4))
    assert climatology.daily_mean(days).df.count() == 365
    with pytest.raises(ValueError):
        climatology.mean(days, frequency="day")
    with pytest.raises(ValueError):
        climatology.mean(days, frequency="month", climatology_range=("2001",))
    assert climatology.mean(days, frequency="month", climatology_range=("2001", None)).df.count() == 12


def test_quantiles(cycle):
    out = climatology.quantiles(cycle, [0.25, 0.5, 0.75], frequency="year")
    assert out.dims == ("year", "quantile") and out.df.count() == 15
    got = out.df.filter("year = 2001 and quantile = 0.25").collect()[0]["var"]
    assert got == pytest.approx(np.quantile(np.arange(1, 13), 0.25))
    assert sorted({r.percentile for r in climatology.percentiles(cycle, [25, 50, 75]).df.collect()}) == [25, 50, 75]
    assert climatology.median(cycle).dims == ("year",)


def test_bins(spark, cycle):
    assert climatology.mean(cycle, frequency="month", bin_widths=3).df.count() == 4
    assert climatology.mean(cycle, frequency="month", bin_widths=[0, 6, 12]).df.count() == 2
    with pytest.raises(ValueError):
        bins("year", F.lit(1), 3)


def test_season_order(spark):
    df = spark.createDataFrame([("SON", 1), ("JJA", 2), ("MAM", 3), ("DJF", 4)], "season string, v int")
    assert [r.season for r in df.orderBy(season_order(F.col("season"))).collect()] == ["DJF", "MAM", "JJA", "SON"]


def test_anomalies(spark, cycle):
    clim = climatology.monthly_mean(cycle)
    assert set(column(climatology.anomaly(cycle, clim, frequency="month"), "var")) == {0.0}
    out = climatology.relative_anomaly(cycle, clim)
    assert set(column(out, "var")) == {0.0} and out.meta("var")["units"] == "%"
    assert climatology.auto_anomaly(cycle, climatology_frequency="month", climatology_range=("2000", "2002")).df.count() == 60
    values = column(climatology.anomaly(cycle, climatology.mean(cycle)), "var")
    assert np.mean(values) == pytest.approx(0)
    with pytest.raises(ValueError):
        climatology.anomaly(cycle, climatology.median(cycle))
    with pytest.raises(ValueError):
        climatology.anomaly(cycle, Cube(clim.df.withColumnRenamed("var", "other"), clim.dims, ("other",)))


META = {"units": "m", "long_name": "total precipitation"}


@pytest.fixture(scope="module")
def rain(spark):
    return series(spark, datetime(2020, 1, 1), timedelta(hours=1), range(1, 6), "tp", meta=META)


def test_rates(rain):
    out = rates.accumulation_to_rate(rain)
    assert out.vars == ("tp_rate",) and out.meta("tp_rate")["units"] == "m s^-1"
    assert column(out, "tp_rate") == pytest.approx([v / 3600 for v in range(1, 6)])
    out = rates.accumulation_to_rate(rain, accumulation_type="start_of_forecast")
    assert column(out, "tp_rate") == pytest.approx([1 / 3600] * 4)
    assert len(column(rates.accumulation_to_rate(rain, accumulation_type="start_of_forecast", from_first_step=True), "tp_rate")) == 5
    out = rates.deaccumulate(rain, from_first_step=True)
    assert out.vars == ("tp",) and column(out, "tp") == [1.0] * 5
    with pytest.raises(ValueError, match="Unknown accumulation_type"):
        rates.accumulation_to_rate(rain, accumulation_type="other")


@pytest.mark.parametrize("units, suffix", [("seconds", " s^-1"), ("minutes", " min^-1"), ("hours", " hours^-1"), ("step_length", ""), ("3 hours", " (3 hours)^-1"), (timedelta(seconds=1), " s^-1"), (timedelta(seconds=90), " (1.5 min)^-1")])
def test_rate_units(rain, units, suffix):
    out = rates.accumulation_to_rate(rain, rate_units=units)
    assert out.meta(out.vars[0])["units"] == f"m{suffix}"


def test_rate_single_forecast_step(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1), 3_600_000_000, 6.0)], "forecast_reference_time timestamp_ntz, forecast_period long, tp double")
    out = rates.accumulation_to_rate(Cube.of(df, ("forecast_reference_time", "forecast_period"), ["tp"]), accumulation_type="start_of_step")
    assert column(out, "tp_rate") == pytest.approx([6 / 3600])


def test_rate_midnight_start(spark):
    cube = series(spark, datetime(2020, 1, 1), timedelta(hours=1), [24, 1, 2], "tp", "valid_time")
    got = column(rates.accumulation_to_rate(cube, accumulation_type="start_of_day", from_first_step=True, rate_units="hours"), "tp_rate")
    assert got == [None, 1.0, 1.0]


def test_rate_over_gap_is_missing(spark):
    rows = [("a", h, float(h)) for h in range(4)] + [("b", h, float(h)) for h in (0, 2, 3)]
    df = spark.createDataFrame([(k, datetime(2020, 1, 1, h), v) for k, h, v in rows], "k string, time timestamp_ntz, v double")
    got = {(r.k, r.time.hour): r.v for r in rates.deaccumulate(Cube.of(df, ("k", "time"), ["v"])).df.collect()}
    assert got["a", 2] == 1.0 and got["b", 2] is None and got["b", 3] == 1.0


@pytest.fixture(scope="module")
def diagonal(spark):
    return Cube.of(spark.createDataFrame([(k, float(k - 2), float(k - 2), k) for k in range(5)], "points int, latitude double, longitude double, test long"), "points", ["test"], ("latitude", "longitude"))


@pytest.fixture(scope="module")
def regular(spark):
    return Cube.of(spark.createDataFrame([(float(y), float(x), float(5 * (y + 2) + x + 2)) for y in range(-2, 3) for x in range(-2, 3)], "latitude double, longitude double, test_reg double"), ("latitude", "longitude"))


A, B, QUAD, CENTRE = box(0.6, 0.6, 1.4, 1.4), box(-1.4, -1.4, -0.6, -0.6), box(0.6, 0.6, 2.4, 2.4), box(-1.4, -1.4, 1.4, 1.4)


def test_latitude_weighted_grid(spark):
    cube = Cube.of(spark.createDataFrame([(float(y), float(x), v) for y, v in ((0, 1), (60, 2), (90, 3)) for x in (0, 30, 60, 90)], "latitude double, longitude double, v long"), ("latitude", "longitude"))
    assert column(spatial.reduce(cube), "v") == [2.0]
    assert column(spatial.reduce(cube, weights="latitude"), "v") == [pytest.approx(4 / 3)]
    assert spatial_info(cube) == {"lat": "latitude", "lon": "longitude", "spatial_dims": ("latitude", "longitude"), "regular": False}


def test_masks_of_points(spark, diagonal):
    shapes = features(spark, [(0, A), (1, B)], "index")
    got = {(r.points, r["index"]): r.test for r in spatial.mask(diagonal, shapes).df.collect()}
    assert {k for k, v in got.items() if v is not None} == {(3, 0), (1, 1)} and len(got) == 10
    union = {r.points: r.test for r in spatial.mask(diagonal, shapes, union_geometries=True).df.collect()}
    assert union == {0: None, 1: 1, 2: None, 3: 3, 4: None}
    assert spatial.mask(diagonal, shapes, compact=True).df.count() == 2


@pytest.mark.parametrize("how, quad, centre", [("mean", 21, 2), ("sum", 84, 6), ("min", 18, 1), ("max", 24, 3)])
def test_zonal(spark, regular, diagonal, how, quad, centre):
    assert column(spatial.reduce(regular, features(spark, [(0, QUAD)], "index"), how), "test_reg") == [quad]
    assert column(spatial.reduce(diagonal, features(spark, [(0, CENTRE)], "index"), how), "test") == [centre]


def test_zonal_labels_and_empty_features(spark, regular):
    shapes = features(spark, [("quad", QUAD), ("b", B), ("far", box(10, 10, 20, 20))], "name")
    got = {r.name: r.test_reg for r in spatial.reduce(regular, shapes, mask_dim="name").df.collect()}
    assert got == {"quad": 21.0, "b": 6.0, "far": None}
    got = {r.name: r.test_reg for r in spatial.reduce(regular, shapes, "sum", mask_dim="name").df.collect()}
    assert got == {"quad": 84.0, "b": 6.0, "far": 0.0}
    out = spatial.reduce(regular, shapes, mask_dim="name", expanded=True)
    assert "rings" in out.df.columns and out.df.count() == 3


def test_holes_and_parts(spark, diagonal):
    ring = box(-1.5, -1.5, 1.5, 1.5) + box(-0.4, -0.4, 0.4, 0.4)
    shapes = features(spark, [(0, ring), (1, A + B), (2, box(10, 10, 20, 20))], "index")
    got = {(r.points, r["index"]) for r in spatial.mask(diagonal, shapes).df.filter("test is not null").collect()}
    assert got == {(1, 0), (3, 0), (1, 1), (3, 1)}


def test_precomputed_masks(spark, regular):
    inside = [regular.df.select("latitude", "longitude", F.when(c, 1.0).otherwise(other).alias("mask")) for c, other in ((F.col("latitude") >= 1, NAN), (F.col("longitude") <= -1, 0.0))]
    got = column(spatial.reduce(regular, mask_arrays=inside), "test_reg", ["index"])
    assert got == [19.5, 10.5]
    assert column(spatial.reduce(regular, mask_arrays=inside[0]), "test_reg", []) == [19.5]
    with pytest.raises(ValueError):
        spatial.reduce(regular, features(spark, [(0, QUAD)], "index"), mask_arrays=inside)


def test_all_touched(spark, regular):
    small = features(spark, [(0, box(0.6, 0.6, 0.9, 0.9))], "index")
    assert spatial.mask(regular, small, compact=True).df.count() == 0
    assert spatial.mask(regular, small, compact=True, all_touched=True).df.count() == 1


def test_ensemble(spark):
    rows = [(m, y, x, 4 * m + 2 * y + x) for m in range(3) for y in range(2) for x in range(2)]
    cube = Cube.of(spark.createDataFrame(rows, "ensemble_member int, lat int, lon int, v long"), ("ensemble_member", "lat", "lon"))
    assert column(ensemble.mean(cube), "v") == [4.0, 5.0, 6.0, 7.0]
    assert column(ensemble.standard_deviation(cube), "v") == pytest.approx([np.std([0, 4, 8])] * 4)
    with pytest.raises(ValueError):
        ensemble.mean(ensemble.mean(cube))


def test_detection(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0)], "foo int, lat int, bar int, v double")
    cube = Cube.of(df.withMetadata("foo", {"axis": "Y"}).withMetadata("bar", {"standard_name": "longitude"}), ("foo", "lat", "bar"), ["v"])
    assert find_axis(cube, "y") == "foo" and find_axis(cube, "x") == "bar" and find_axis(cube, "t") is None
    with pytest.raises(ValueError):
        find_axis(cube, "t", required=True)
    assert evenly_spaced([1.0]) and evenly_spaced([0, 1, 2]) and not evenly_spaced([0, 1, 3])


def test_frequency_inference(spark):
    assert infer_frequency(series(spark, datetime(2020, 1, 1), months, range(24))) == "month"
    assert infer_frequency(series(spark, datetime(2020, 1, 1), timedelta(days=1), range(5))) == "dayofyear"
    with pytest.raises(ValueError):
        infer_frequency(series(spark, datetime(2020, 1, 1), timedelta(days=1), [1]))


def test_absent_null_and_nan_agree(spark):
    t = [datetime(2020, 1, 1, h) for h in range(4)]
    schema = "k string, time timestamp_ntz, v double"
    whole = [("a", x, float(k)) for k, x in enumerate(t)]
    variants = [whole + [("b", x, v) for x, v in zip(t, (1.0, m, 3.0, 4.0), strict=True) if v != "gone"] for m in (None, NAN, "gone")]
    cubes = [Cube.of(spark.createDataFrame(v, schema).repartition(3), ("k", "time")) for v in variants]
    for f in (lambda c: temporal.daily_mean(c), lambda c: core.reduce(c, "std", dim="time"), lambda c: core.reduce(c, "median", dim="time"), lambda c: core.reduce(c, "sum", dim="time")):
        got = [sorted((*r[:-1], round(r[-1], 9)) for r in f(c).df.collect()) for c in cubes]
        assert got[0] == got[1] == got[2]


def test_attributes_survive(spark):
    cube = series(spark, datetime(2020, 1, 1), timedelta(hours=1), range(48), meta={"units": "K"})
    assert temporal.daily_mean(cube).meta("var") == {"units": "K"}


def test_options_are_checked(nan2x2):
    with pytest.raises(TypeError, match="skip"):
        core.reduce(nan2x2, "mean", skip=True)
    with pytest.raises(TypeError):
        core.reduce(nan2x2, "max", q=0.5)
    with pytest.raises(ValueError, match="needs weights"):
        core.reduce(nan2x2, "sum_of_weights")


def test_rolling_takes_functions_as_they_are(grid5):
    def mean(x, axis=None):
        return -1.0

    out = core.rolling_reduce(grid5, mean, dim={grid5.dims[0]: 3}, min_periods=1)
    assert set(column(out, out.vars[0])) == {-1.0}
    both = core.rolling_reduce(grid5, np.nansum, dim=dict.fromkeys(grid5.dims, 2))
    assert column(both, both.vars[0]) == column(core.rolling_reduce(grid5, "sum", dim=dict.fromkeys(grid5.dims, 2)), both.vars[0])


def test_weights_that_share_nothing(spark, nan2x2):
    with pytest.raises(ValueError, match="share no dimension"):
        core.reduce(nan2x2, "mean", weights=spark.createDataFrame([(1.0,), (2.0,)], "w double"))


def test_climatology_by_tag(spark):
    cube = series(spark, datetime(2020, 1, 1), timedelta(days=1), [1, 2, 3])
    v = cube.vars[0]
    own = Cube.of(spark.createDataFrame([(2.0, 9.0)], f"{v}_mean double, {v}_std double"), (), [f"{v}_mean", f"{v}_std"])
    assert column(climatology.anomaly(cube, own, climatology_how_tag="mean"), v) == [-1.0, 0.0, 1.0]
    with pytest.raises(KeyError):
        climatology.anomaly(cube, own)


def test_squeeze(spark):
    cube = Cube.of(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "k string, n int, v double"), ("k", "n"))
    assert core.squeeze(cube).dims == ("n",) and core.squeeze(cube, keep=("k",)).dims == ("k", "n")
    with pytest.raises(ValueError):
        core.squeeze(cube, "n")


def test_rate_history_is_kept(spark):
    cube = series(spark, datetime(2020, 1, 1), timedelta(hours=1), [1, 2], "tp", meta={"history": "made", "long_name": "rain"})
    meta = rates.accumulation_to_rate(cube, rate_label="mean_rate").meta("tp_mean_rate")
    assert meta["history"].startswith("made\n") and meta["long_name"] == "rain mean rate"
    assert "history" not in rates.accumulation_to_rate(series(spark, datetime(2020, 1, 1), timedelta(hours=1), [1, 2], "tp"), provenance=False).meta("tp_rate")
