"""NetCDF files written byte by byte, by hand, against what the source reads, and round trips."""

import math
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from gridloom.cube import Cube
from gridloom.sources import from_netcdf, to_netcdf
from gridloom.sources.netcdf import NetcdfReader, Netcdf, read_header
from gridloom.sources.ranges import Ranges

CODES = {"b": 1, "c": 2, "h": 3, "i": 4, "f": 5, "d": 6, "q": 10}


def encode(version, dims, variables, records, streamed=False, attributes=()):
    """variables: (name, dims, attributes, code, array); the record dimension has size 0 in dims."""
    wide = version == 5
    count = lambda n: struct.pack(">q" if wide else ">i", n)
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
    named = lambda s: count(len(s.encode())) + pad(s.encode())

    def atts(items):
        out = b""
        for k, v in items:
            code, raw, n = ("c", v.encode(), len(v)) if isinstance(v, str) else (v[0], struct.pack(f">{len(v) - 1}{v[0]}", *v[1:]), len(v) - 1)
            out += named(k) + struct.pack(">i", CODES[code]) + count(n) + pad(raw)
        return (struct.pack(">i", 12) if items else b"\0\0\0\0") + count(len(items)) + out

    order = list(dims)
    isrec = {n: bool(own) and dims[own[0]] == 0 for n, own, *_ in variables}
    raws, sizes = {}, {}
    alone = sum(isrec.values()) == 1
    for n, _, _, code, array in variables:
        a = np.asarray(array).astype(f">{np.dtype(code).str[1:]}") if code != "c" else np.frombuffer(array, "S1")
        if isrec[n]:
            raws[n] = [a[k : k + 1].tobytes() if alone else pad(a[k : k + 1].tobytes()) for k in range(records)]
            sizes[n] = len(raws[n][0]) if records else 0
        else:
            raws[n] = pad(a.tobytes())
            sizes[n] = len(raws[n])

    def head(begin):
        out = b"CDF" + bytes([version]) + (b"\xff" * (8 if wide else 4) if streamed else count(records))
        out += (struct.pack(">i", 10) if dims else b"\0\0\0\0") + count(len(dims)) + b"".join(named(d) + count(n) for d, n in dims.items())
        out += atts(list(attributes)) + struct.pack(">i", 11) + count(len(variables))
        for n, own, items, code, _ in variables:
            out += named(n) + count(len(own)) + b"".join(count(order.index(d)) for d in own) + atts(items) + struct.pack(">i", CODES[code]) + count(sizes[n]) + struct.pack(">i" if version == 1 else ">q", begin.get(n, 0))
        return out

    at, begin = len(head({})), {}
    for rec in (False, True):
        for n, *_ in variables:
            if isrec[n] == rec:
                begin[n] = at
                at += sizes[n]
    body = b"".join(raws[n] for n, *_ in variables if not isrec[n])
    body += b"".join(raws[n][k] for k in range(records) for n, *_ in variables if isrec[n])
    return head(begin) + body


def example(records=5, lats=3, lons=4):
    rng = np.random.default_rng(1)
    t2m = rng.integers(-300, 300, (records, lats, lons))
    t2m[1, 2, 3] = -999
    variables = [
        ("lat", ("lat",), [("units", "degrees_north"), ("standard_name", "latitude")], "f", [60.0 - 10 * k for k in range(lats)]),
        ("lon", ("lon",), [("units", "degrees_east")], "d", [10.0 * k for k in range(lons)]),
        ("time", ("time",), [("units", "hours since 1990-01-01 06:00")], "i", np.arange(records) * 12),
        ("t2m", ("time", "lat", "lon"), [("scale_factor", ("d", 0.5)), ("add_offset", ("d", 273.0)), ("_FillValue", ("h", -999)), ("units", "K")], "h", t2m),
        ("flag", ("time", "lat"), [], "b", np.arange(records * lats).reshape(records, lats) % 7),
        ("height", ("lat", "lon"), [], "f", np.where(np.eye(lats, lons) > 0, np.nan, np.arange(lats * lons).reshape(lats, lons))),
        ("crs", (), [("grid", "x")], "i", 7),
        ("label", ("lat",), [], "c", b"abc" * (lats // 3)),
    ]
    return variables, t2m


def expected(t2m):
    start = datetime(1990, 1, 1, 6)
    return {(datetime.fromtimestamp(start.timestamp() + 43200 * t), 60.0 - 10 * y, 10.0 * x): None if t2m[t, y, x] == -999 else 0.5 * t2m[t, y, x] + 273.0 for t, y, x in np.ndindex(t2m.shape)}


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("streamed", [False, True])
def test_records_of_several_variables(spark, tmp_path, version, streamed):
    variables, t2m = example()
    (tmp_path / "a.nc").write_bytes(encode(version, {"time": 0, "lat": 3, "lon": 4}, variables, 5, streamed, [("title", "made up")]))
    cube = from_netcdf(spark, str(tmp_path), split_bytes=200)
    assert cube.dims == ("time", "lat", "lon") and cube.vars == ("t2m",) and cube.attrs == {"title": "made up"}
    assert cube.meta("lat") == {"units": "degrees_north", "standard_name": "latitude"} and cube.meta("t2m") == {"units": "K"}
    assert cube.df.rdd.getNumPartitions() > 1
    got = {tuple(r)[:3]: r.t2m for r in cube.df.collect()}
    assert len(got) == 60 and got == expected(t2m)
    both = from_netcdf(spark, str(tmp_path / "a.nc"), ["t2m", "flag", "height"]).df.orderBy("time", F.desc("lat"), "lon").collect()
    assert [r.flag for r in both] == [v for k in range(15) for v in [k % 7] * 4] and both[0].height is None and both[1].height == 1.0 and len(both) == 60


@pytest.mark.parametrize("version", [1, 5])
def test_one_record_variable_is_not_padded(spark, tmp_path, version):
    data = np.arange(7 * 3).reshape(7, 3)
    (tmp_path / "b.nc").write_bytes(encode(version, {"step": 0, "x": 3}, [("v", ("step", "x"), [], "b", data)], 7))
    cube = from_netcdf(spark, str(tmp_path / "b.nc"))
    assert sorted((r.step, r.x, r.v) for r in cube.df.collect()) == [(k, x, 3 * k + x) for k in range(7) for x in range(3)]


def test_filters_read_less(spark, tmp_path):
    variables, t2m = example(200, 30, 40)
    path = str(tmp_path / "a.nc")
    (tmp_path / "a.nc").write_bytes(encode(2, {"time": 0, "lat": 30, "lon": 40}, variables, 200))
    schema = Netcdf({"path": path}).schema()

    def run(*filters):
        reader = NetcdfReader(schema, path, None, 1 << 20)
        left = list(reader.pushFilters(list(filters)))
        read = Ranges(path)
        cells = sum(len(b) for b in reader.cells(read, 0, 1))
        return cells, read.bytes_read, len(left)

    whole, everything, _ = run()
    assert whole == 200 * 1200 and everything >= 2 * whole
    late = datetime(1990, 4, 1)
    labels = sorted({t for t, *_ in expected(t2m)})
    n = sum(t >= late for t in labels)
    cells, read, left = run(GreaterThanOrEqual(("time",), late))
    assert (cells, left) == (1200 * n, 0) and read - (1 << 16) < everything * n / 200
    rows = run(GreaterThanOrEqual(("time",), late), In(("lat",), (50.0, 60.0)))
    assert rows[0] == 80 * n and rows[1] - (1 << 16) < everything * n / 200 / 10
    one = run(EqualTo(("time",), labels[0]), LessThan(("lon",), 15.0), EqualTo(("t2m",), 1.0))
    assert one[0] == 60 and one[2] == 1 and one[1] < (1 << 16) + 8000
    assert run(EqualTo(("lat",), 1.0))[0] == 0
    # Spark sends its filters down itself
    df = from_netcdf(spark, path).df.filter((F.col("time") >= F.lit(late).cast("timestamp_ntz")) & (F.col("lat") == 50))
    assert df.count() == 40 * n and {r.lat for r in df.collect()} == {50.0}
    assert " Filter " not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("units", "calendar", "values", "want"), [
    ("days since 2000-02-28", "standard", [0, 1.5], [datetime(2000, 2, 28), datetime(2000, 2, 29, 12)]),
    ("days since 2000-02-28", "noleap", [0, 1.5, 400], ["2000-02-28 00:00:00", "2000-03-01 12:00:00", "2001-04-04 00:00:00"]),
    ("days since 2000-01-30 12:00:00", "360_day", [0, 0.5, 359], ["2000-01-30 12:00:00", "2000-02-01 00:00:00", "2001-01-29 12:00:00"]),
    ("seconds since 1970-01-01T00:00:00Z", "gregorian", [1, 2.25], [datetime(1970, 1, 1, 0, 0, 1), datetime(1970, 1, 1, 0, 0, 2, 250000)]),
    ("fathoms", "standard", [1, 2], [1.0, 2.0]),
])
def test_times(spark, tmp_path, units, calendar, values, want):
    variables = [("time", ("time",), [("units", units), ("calendar", calendar)], "d", values), ("v", ("time",), [], "d", values)]
    (tmp_path / "t.nc").write_bytes(encode(2, {"time": len(values)}, variables, 0))
    assert [r.time for r in from_netcdf(spark, str(tmp_path / "t.nc")).df.orderBy("v").collect()] == want


@pytest.mark.parametrize("version", [1, 2, 5])
def test_round_trip(spark, tmp_path, version):
    rows = spark.sql("select timestamp_ntz'2024-01-01' + make_dt_interval(0, 6 * cast(t as int)) as time, 10.0D * y as lat, x as lon, cast(t * 100 + y * 10 + x as double) as v, cast(if(x = 1, null, y) as double) as w from (select id as t from range(23)), (select id as y from range(3)), (select id as x from range(4)) where (t + y + x) % 5 <> 0").withMetadata("v", {"units": "m"})
    cube = Cube.of(rows, ("time", "lat", "lon"), attrs={"title": "t"})
    path = str(tmp_path / "out")
    to_netcdf(cube, path, version, file_bytes=1000)
    assert len(list((tmp_path / "out").glob("*.nc"))) == 5 and not list((tmp_path / "out").glob("_*"))
    back = from_netcdf(spark, path)
    assert back.dims == cube.dims and back.vars == ("v", "w") and back.meta("v") == {"units": "m"} and back.attrs == {"title": "t"}
    want = {tuple(r)[:3]: (r.v, r.w) for r in rows.collect()}
    got = {(r.time, r.lat, int(r.lon)): (r.v, r.w) for r in back.df.collect()}
    assert len(got) == 23 * 12 and {k: v for k, v in got.items() if v != (None, None)} == {k: v for k, v in want.items() if v != (None, None)}
    assert math.isclose(back.df.filter(F.col("time") < "2024-01-02").agg(F.sum("v")).first()[0], sum(v for (t, *_), (v, _) in want.items() if t < datetime(2024, 1, 2)))
    with pytest.raises(ValueError, match="labels that are neither"):
        to_netcdf(Cube.of(spark.sql("select 'a' as k, 1.0D as v"), "k"), path)


def test_what_is_not_netcdf(spark, tmp_path):
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    (tmp_path / "c.nc").write_bytes(encode(1, {"x": 3}, [("v", ("x",), [], "d", [1, 2, 3])], 0)[:40])
    for name, said in (("h.nc", "HDF5"), ("c.nc", "cut off")):
        with pytest.raises(ValueError, match=said):
            read_header(Ranges(str(tmp_path / name)))
    with pytest.raises(Exception, match="none.nc"):
        from_netcdf(spark, str(tmp_path / "none.nc"))
