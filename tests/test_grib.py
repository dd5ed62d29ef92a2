"""GRIB messages laid out by hand and by the library's own encoder, against what the source reads."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

from gridloom.cube import Cube
from gridloom.sources.grib import GribReader, encode, from_grib, grib_table, integers, message_index, messages, to_grib
from gridloom.sources.ranges import Ranges

LATS, LONS = np.array([60.0, 50, 40]), np.array([350.0, 0, 10, 20])


def field(seed):
    return np.random.default_rng(seed).normal(280, 15, (3, 4))


def edition1(values, bits=12, decimal=1, bitmap=None, scan=0, time=(2001, 2, 3, 4, 0), ahead=(1, 6, 0, 0)):
    """Written out from the layout of edition 1, with its floats of base 16."""
    x = (values.ravel() if bitmap is None else values.ravel()[bitmap]) * 10.0**decimal
    low = float(np.floor(x.min()))
    exponent = 64
    while abs(low) >= 16.0 ** (exponent - 64):
        exponent += 1
    ibm = ((1 if low < 0 else 0) << 31 | exponent << 24 | round(abs(low) / 16.0 ** (exponent - 64) * 2**24)).to_bytes(4, "big")
    binary = int(np.ceil(np.log2((x.max() - low) / (2**bits - 1))))
    n = np.round((x - low) / 2.0**binary).astype(int)
    text = "".join(f"{k:0{bits}b}" for k in n)
    unused = -len(text) % 16 if (len(text) + 88) % 16 == 0 else (16 - (len(text) + 88) % 16)
    text += "0" * unused
    data = int(text, 2).to_bytes(len(text) // 8, "big")
    sign = lambda v, size: ((1 << (8 * size - 1) if v < 0 else 0) | abs(v)).to_bytes(size, "big")
    pds = (28).to_bytes(3, "big") + bytes([128, 98, 0, 255, 0x80 | (0x40 if bitmap is not None else 0), 167, 1]) + (0).to_bytes(2, "big") + bytes([time[0] % 100, *time[1:5], *ahead]) + bytes([0, 0, 0]) + bytes([time[0] // 100 + 1, 0]) + sign(decimal, 2)
    gds = (32).to_bytes(3, "big") + bytes([0, 255, 0]) + (4).to_bytes(2, "big") + (3).to_bytes(2, "big") + sign(60000, 3) + sign(-10000, 3) + bytes([128]) + sign(40000, 3) + sign(20000, 3) + (10000).to_bytes(2, "big") * 2 + bytes([scan]) + bytes(4)
    bms = b"" if bitmap is None else (6 + 2).to_bytes(3, "big") + bytes([4, 0, 0]) + np.packbits(bitmap).tobytes()
    bds = (11 + len(data)).to_bytes(3, "big") + bytes([unused]) + sign(binary, 2) + ibm + bytes([bits]) + data
    body = pds + gds + bms + bds + b"7777"
    return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + bytes([1]) + body


def close(rows, values, tolerance):
    got = {(r.latitude, r.longitude): r.value for r in rows}
    assert len(got) == 12
    for i, y in enumerate(LATS):
        for j, x in enumerate([-10.0, 0, 10, 20]):
            v = values[i, j]
            assert got[y, x] is None if np.isnan(v) else abs(got[y, x] - v) <= tolerance


def test_both_editions(spark, tmp_path):
    holed = field(3)
    holed[1, 2] = np.nan
    one, two = field(1), field(2)
    raw = b"leading rubbish GRIB" + edition1(one) + b"\0" * 7 + encode(two, LATS, LONS, datetime(2001, 2, 3, 4), hours=12, parameter=(0, 3, 1), level=(100, 850.0), member=7, bits=16) + edition1(holed, bitmap=~np.isnan(holed.ravel()), ahead=(1, 0, 24, 4))
    (tmp_path / "a.grib").write_bytes(raw)
    df = grib_table(spark, str(tmp_path))
    first = df.filter("param = '2t' and step = 21600000000L").collect()
    close(first, one, 15 * 6 / 2**12 * 1.1)
    assert {(r.level_type, r.level, r.forecast_reference_time, r.valid_time, r.number) for r in first} == {(1, 0.0, datetime(2001, 2, 3, 4), datetime(2001, 2, 3, 10), None)}
    second = df.filter("param = 'prmsl'").collect()
    close(second, two, 15 * 6 / 2**16 * 1.1)
    assert {(r.level_type, r.level, r.step, r.valid_time, r.number) for r in second} == {(100, 850.0, 12 * 3_600_000_000, datetime(2001, 2, 3, 16), 7)}
    close(df.filter("param = '2t' and step = 86400000000L").collect(), holed, 15 * 6 / 2**12 * 1.1)
    index = message_index(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.edition, r.param, r.rows, r.columns, r.bits) for r in index] == [(1, "2t", 3, 4, 12), (2, "prmsl", 3, 4, 16), (1, "2t", 3, 4, 12)] and index[0].offset == 16 + 4
    cube = from_grib(spark, str(tmp_path), "prmsl", ("number", "latitude", "longitude"), level=850)
    assert cube.vars == ("prmsl",) and cube.df.count() == 12


def test_every_split_gives_each_message_once(spark, tmp_path):
    raw = b"".join(encode(field(k), LATS, LONS, datetime(2001, 1, 1 + k)) for k in range(9))
    (tmp_path / "a.grib2").write_bytes(raw)
    path, size = str(tmp_path / "a.grib2"), len(raw)
    for split in (1, 7, 50, 100, 1000, size):
        read = Ranges(path)
        found = [m.keys["valid_time"].day for k in range(0, size, split) for m in messages(read, k, min(size, k + split))]
        assert found == list(range(1, 10)), split
    df = grib_table(spark, path, split_bytes=300)
    assert df.rdd.getNumPartitions() == -(-size // 300) and df.count() == 9 * 12


def test_filters_leave_values_unread(tmp_path):
    big_lats, big_lons = np.linspace(90, -90, 181), np.linspace(0, 359, 360)
    raw = b"".join(encode(np.random.default_rng(k).random((181, 360)), big_lats, big_lons, datetime(2001, 1, 1 + k)) for k in range(6))
    (tmp_path / "a.grib2").write_bytes(raw)

    def run(*filters):
        reader = GribReader(str(tmp_path), 1 << 30)
        left = reader.pushFilters(list(filters))
        read = Ranges(str(tmp_path / "a.grib2"))
        return sum(len(b) for b in reader.cells(read, 0, read.size)), read.bytes_read, len(left)

    everything = run()
    assert everything[0] == 6 * 181 * 360
    late = run(GreaterThanOrEqual(("valid_time",), datetime(2001, 1, 5)))
    assert late[0] == 2 * 181 * 360 and late[1] < everything[1] * 0.36 and late[2] == 0
    part = run(EqualTo(("param",), "t"), GreaterThan(("latitude",), 80.0), LessThan(("longitude",), -90.0), GreaterThan(("value",), 0.5))
    assert part[0] == 6 * 10 * 90 and part[2] == 1
    assert run(EqualTo(("param",), "v"))[:2] < (1, everything[1] // 50) and run(EqualTo(("number",), 1))[0] == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 12, 16, 24, 31, 32])
def test_integers(bits):
    want = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    text = "".join(f"{k:0{bits}b}" for k in want)
    text += "0" * (-len(text) % 8)
    assert (integers(int(text, 2).to_bytes(len(text) // 8, "big"), bits, 1001) == want).all()


def test_long_integers_in_parts(monkeypatch):
    want = np.random.default_rng(0).integers(0, 1 << 11, (8 << 17) + 77)
    raw = np.packbits(((want[:, None] >> np.arange(10, -1, -1)) & 1).astype(np.uint8)).tobytes()
    assert (integers(raw, 11, len(want)) == want).all()


@pytest.mark.parametrize(("scan", "turn"), [(0, lambda a: a), (0x20, lambda a: a.T.reshape(3, 4)), (0x10, lambda a: np.stack([a[0], a[1, ::-1], a[2]]))])
def test_scanning(spark, tmp_path, scan, turn):
    values = field(4)
    laid = values.T.ravel().reshape(3, 4) if scan == 0x20 else turn(values)
    (tmp_path / "s.grb").write_bytes(edition1(laid, scan=scan))
    close(grib_table(spark, str(tmp_path)).collect(), values, 0.1)


def test_constant_and_all_missing_fields(spark, tmp_path):
    (tmp_path / "c.grb2").write_bytes(encode(np.full((3, 4), 7.5), LATS, LONS, datetime(2001, 1, 1)) + encode(np.full((3, 4), np.nan), LATS, LONS, datetime(2001, 1, 2)))
    rows = grib_table(spark, str(tmp_path)).collect()
    assert {(r.valid_time.day, r.value) for r in rows} == {(1, 7.5), (2, None)}


def test_round_trip_within_packing(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01' + make_dt_interval(t) as time, 10.0D * y as lat, 5.0D * x as lon, t * 1.25D + y * y - x as v from (select cast(id as int) as t from range(5)), (select id as y from range(4)), (select id as x from range(6)) where (t + x + y) % 7 <> 0")
    to_grib(Cube.of(rows, ("time", "lat", "lon")), str(tmp_path / "out"), "time", "lat", "lon", parameter=(0, 1, 8), bits=20)
    back = from_grib(spark, str(tmp_path / "out"), "tp").df.filter("tp is not null").collect()
    want = {(r.time, r.lat, r.lon): r.v for r in rows.collect()}
    assert {(r.valid_time, r.latitude, r.longitude) for r in back} == set(want) and max(abs(r.tp - want[r.valid_time, r.latitude, r.longitude]) for r in back) < 20 / 2**20
    with pytest.raises(ValueError, match="evenly"):
        to_grib(Cube.of(rows.withColumn("lat", F.col("lat") ** 2), ("time", "lat", "lon")), str(tmp_path / "no"), "time", "lat", "lon")


def test_what_it_does_not_read(tmp_path):
    raw = bytearray(encode(field(1), LATS, LONS, datetime(2001, 1, 1)))
    at = raw.index(struct.pack(">I", 12), 60)  # number of values in section 5
    raw[at + 5] = 40
    (tmp_path / "j.grib2").write_bytes(raw)
    with pytest.raises(NotImplementedError, match="5.40"):
        read = Ranges(str(tmp_path / "j.grib2"))
        list(messages(read, 0, read.size))
