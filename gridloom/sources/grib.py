"""GRIB files of edition 1 and 2, regular latitude-longitude grids in simple packing, as a Spark data
source.

A partition is a range of bytes of a file; it reads the messages that begin there. Of each message the
sections that describe it come first, and only where the filters leave it the packed values are read
and unpacked, all at once in numpy. Cells come as Arrow batches. ``message_index`` gives the offsets
and keys of all messages without their values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, DoubleType

from ..cube import Cube
from .ranges import SPLIT_BYTES, Ranges, files, passing, timestamps, usable

# Fixed values of the format: names of common parameters, by discipline, category and number in edition 2 and by
# number of the usual table in edition 1; minutes of time units; types of level.
NAMES2 = {(0, 0, 0): "t", (0, 0, 6): "dpt", (0, 1, 0): "q", (0, 1, 1): "r", (0, 1, 8): "tp", (0, 2, 2): "u", (0, 2, 3): "v", (0, 2, 8): "w", (0, 3, 0): "sp", (0, 3, 1): "prmsl", (0, 3, 5): "gh", (0, 6, 1): "tcc"}
NAMES1 = {129: "z", 130: "t", 131: "u", 132: "v", 133: "q", 134: "sp", 135: "w", 151: "msl", 157: "r", 164: "tcc", 165: "10u", 166: "10v", 167: "2t", 168: "2d", 228: "tp"}
MINUTES = {0: 1, 1: 60, 2: 1440, 10: 180, 11: 360, 12: 720, 13: 1 / 60}
ENDINGS = (".grib", ".grb", ".grib2", ".grb2", ".grib1", ".grb1")

KEYS = ("param", "level_type", "level", "forecast_reference_time", "step", "valid_time", "number")
SCHEMA = StructType(
    [StructField("param", StringType()), StructField("level_type", IntegerType()), StructField("level", DoubleType()), StructField("forecast_reference_time", TimestampNTZType())]
    + [StructField("step", LongType()), StructField("valid_time", TimestampNTZType()), StructField("number", IntegerType())]
    + [StructField("latitude", DoubleType(), True, {"standard_name": "latitude"}), StructField("longitude", DoubleType(), True, {"standard_name": "longitude"}), StructField("value", DoubleType())]
)


@dataclass
class Grid:
    rows: int
    columns: int
    first: tuple[float, float]
    last: tuple[float, float]
    scan: int

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Latitudes of the rows and longitudes of the columns, as they follow each other."""
        (y0, x0), (y1, x1) = self.first, self.last
        if self.scan & 0x80:  # from east to west
            x1 = x1 - 360 if x1 > x0 else x1
        else:
            x1 = x1 + 360 if x1 < x0 else x1
        x = np.round(np.linspace(x0, x1, self.columns), 9)
        return np.round(np.linspace(y0, y1, self.rows), 9), np.where(x >= 180, x - 360, x)


@dataclass
class Packing:
    """value = (reference + integer * 2^binary) / 10^decimal, integers of ``bits`` bits."""

    reference: float
    binary: int
    decimal: int
    bits: int
    count: int


@dataclass
class Message:
    """What describes a message or a field of it, and where its bit map and values lie."""

    offset: int
    length: int
    edition: int
    keys: dict
    grid: Grid
    packing: Packing
    bitmap: tuple[int, int] | None
    data: tuple[int, int]


def _signed(n: int, bits: int) -> int:
    """Sign and magnitude."""
    return -(n & ((1 << (bits - 1)) - 1)) if n >> (bits - 1) else n


def _keys(param: str, level_type: int, level: float | None, reference: datetime, minutes: float, number: int | None) -> dict:
    step = timedelta(minutes=minutes)
    return {"param": param, "level_type": level_type, "level": level, "forecast_reference_time": reference, "step": step // timedelta(microseconds=1), "valid_time": reference + step, "number": number}


# Edition 2
def _product(raw: bytes, discipline: int, reference: datetime) -> dict:
    template = int.from_bytes(raw[7:9], "big")
    if template not in (0, 1, 8, 11):
        raise NotImplementedError(f"product template 4.{template}")
    category, parameter = raw[9], raw[10]
    unit, ahead = raw[17], int.from_bytes(raw[18:22], "big", signed=False)
    level_type, scale, value = raw[22], _signed(raw[23], 8), int.from_bytes(raw[24:28], "big")
    level = None if value == 0xFFFFFFFF else _signed(value, 32) / 10.0**scale
    member = raw[35] if template in (1, 11) else None
    minutes = _signed(ahead, 32) * MINUTES[unit]
    if template in (8, 11):  # over an interval: labelled by its end
        at = 34 if template == 8 else 37
        end = datetime(int.from_bytes(raw[at : at + 2], "big"), *raw[at + 2 : at + 7])
        minutes = (end - reference) / timedelta(minutes=1)
    name = NAMES2.get((discipline, category, parameter), f"p{discipline}_{category}_{parameter}")
    return _keys(name, level_type, level, reference, minutes, member)


def _grid2(raw: bytes) -> Grid:
    template = int.from_bytes(raw[12:14], "big")
    if template != 0:
        raise NotImplementedError(f"grid template 3.{template}: regular latitude-longitude grids only")
    columns, rows, angle, parts = (int.from_bytes(raw[k : k + 4], "big") for k in (30, 34, 38, 42))
    unit = angle / parts if angle and parts != 0xFFFFFFFF else 1e-6
    y0, x0, y1, x1 = (_signed(int.from_bytes(raw[k : k + 4], "big"), 32) * unit for k in (46, 50, 55, 59))
    return Grid(rows, columns, (y0, x0), (y1, x1), raw[71])


def _fields2(read: Ranges, at: int, length: int) -> Iterator[Message]:
    """The fields of a message: sections 2 to 7, or some last ones of them, may repeat."""
    discipline = read(at + 6, 1)[0]
    here, end = at + 16, at + length - 4
    reference = grid = keys = packing = bitmap = None
    while here < end:
        head = read(here, 5)
        n, section = int.from_bytes(head[:4], "big"), head[4]
        if n < 5 or here + n > end:
            raise ValueError(f"section {section} of {n} bytes at {here}")
        if section == 7:
            yield Message(at, length, 2, keys, grid, packing, bitmap, (here + 5, n - 5))
        elif section == 6:
            kind = read(here + 5, 1)[0]
            if kind not in (0, 254, 255):
                raise NotImplementedError(f"predefined bit map {kind}")
            if kind != 254:  # 254: the one before holds
                bitmap = (here + 6, n - 6) if kind == 0 else None
        elif section in (1, 3, 4, 5):
            raw = read(here, n)
            if section == 1:
                reference = datetime(int.from_bytes(raw[12:14], "big"), *raw[14:19])
            elif section == 3:
                grid = _grid2(raw)
            elif section == 4:
                keys = _product(raw, discipline, reference)
            else:
                template = int.from_bytes(raw[9:11], "big")
                if template != 0:
                    raise NotImplementedError(f"data template 5.{template}: simple packing only")
                packing = Packing(struct.unpack(">f", raw[11:15])[0], *(_signed(int.from_bytes(raw[k : k + 2], "big"), 16) for k in (15, 17)), raw[19], int.from_bytes(raw[5:9], "big"))
        here += n


# Edition 1
def _ibm(raw: bytes) -> float:
    """A float of base 16."""
    n = int.from_bytes(raw, "big")
    return (-1.0 if n >> 31 else 1.0) * (n & 0xFFFFFF) / 2.0**24 * 16.0 ** ((n >> 24 & 0x7F) - 64)


def _fields1(read: Ranges, at: int, length: int) -> Iterator[Message]:
    here = at + 8
    head = read(here, 28)
    n = int.from_bytes(head[:3], "big")
    product = head + (read(here + 28, n - 28) if n > 28 else b"")
    here += n
    has_grid, has_map = product[7] & 0x80, product[7] & 0x40
    if not has_grid:
        raise NotImplementedError("a message without a grid")
    n = int.from_bytes(read(here, 3), "big")
    raw = read(here, n)
    if raw[5] != 0:
        raise NotImplementedError(f"grid type {raw[5]}: regular latitude-longitude grids only")
    corner = [_signed(int.from_bytes(raw[k : k + 3], "big"), 24) / 1000 for k in (10, 13, 17, 20)]
    grid = Grid(int.from_bytes(raw[8:10], "big"), int.from_bytes(raw[6:8], "big"), (corner[0], corner[1]), (corner[2], corner[3]), raw[27])
    here += n
    bitmap = None
    if has_map:
        raw = read(here, 6)
        n = int.from_bytes(raw[:3], "big")
        if int.from_bytes(raw[4:6], "big"):
            raise NotImplementedError("a predefined bit map")
        bitmap = (here + 6, n - 6)
        here += n
    raw = read(here, 11)
    n, flags = int.from_bytes(raw[:3], "big"), raw[3]
    if flags & 0xC0:
        raise NotImplementedError("simple packing of grid points only")
    bits = raw[10]
    count = (8 * (n - 11) - (flags & 15)) // bits if bits else grid.rows * grid.columns
    packing = Packing(_ibm(raw[6:10]), _signed(int.from_bytes(raw[4:6], "big"), 16), _signed(int.from_bytes(product[26:28], "big"), 16), bits, count)
    year = (product[24] - 1) * 100 + product[12]
    unit, first, second, kind = product[17:21]
    ahead = {0: first, 1: 0, 10: first << 8 | second}.get(kind, second)
    keys = _keys(NAMES1.get(product[8], f"p{product[3]}_{product[8]}"), product[9], float(int.from_bytes(product[10:12], "big")), datetime(year, *product[13:17]), ahead * MINUTES[unit], product[49] if len(product) > 49 and product[40] else None)
    yield Message(at, length, 1, keys, grid, packing, bitmap, (here + 11, n - 11))


def _length(read: Ranges, at: int) -> int | None:
    """Bytes of the message at a place, if one begins there."""
    if at + 16 > read.size:
        return None
    head = read(at, 16)
    if head[:4] != b"GRIB" or head[7] not in (1, 2):
        return None
    n = int.from_bytes(head[8:16], "big") if head[7] == 2 else int.from_bytes(head[4:7], "big")
    return n if 20 <= n <= read.size - at and read(at + n - 4, 4) == b"7777" else None


def messages(read: Ranges, low: int, high: int) -> Iterator[Message]:
    """Fields of the messages that begin from low to before high. What isn't a message is passed over."""
    at = low
    while at < high:
        n = _length(read, at)
        if n is None:
            block = read(at, min(1 << 16, read.size - at))
            found = block.find(b"GRIB", 1)
            at += found if found > 0 else max(1, len(block) - 3)
            continue
        yield from (_fields2 if read(at + 7, 1)[0] == 2 else _fields1)(read, at, n)
        at += n


def integers(raw: bytes, bits: int, count: int) -> np.ndarray:
    """Unsigned integers of so many bits each, one after another."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", count).astype(np.int64)
    out = np.zeros(count, np.int64)
    each = 8 << 17  # integers at a time, of whole bytes
    for lo in range(0, count, each):
        n = min(each, count - lo)
        part = np.unpackbits(np.frombuffer(raw, np.uint8)[lo * bits // 8 : -(-(lo + n) * bits // 8)], count=n * bits).reshape(n, bits)
        for k in range(bits):
            out[lo : lo + n] = out[lo : lo + n] << 1 | part[:, k]
    return out


def decode(read: Ranges, m: Message) -> np.ndarray:
    """Values by row and column in the order of the grid's axes; missing ones are NaN."""
    p, points = m.packing, m.grid.rows * m.grid.columns
    raw = read(*m.data) if p.bits else b""
    packed = integers(raw, p.bits, p.count) if p.bits else np.zeros(p.count, np.int64)
    values = (p.reference + packed * 2.0**p.binary) / 10.0**p.decimal
    out = np.full(points, np.nan)
    if m.bitmap:
        there = np.unpackbits(np.frombuffer(read(*m.bitmap), np.uint8), count=points).astype(bool)
        out[there] = values[: int(there.sum())]
    else:
        out[:] = values[:points]
    grid, scan = m.grid, m.grid.scan
    shape = out.reshape(grid.columns, grid.rows).T if scan & 0x20 else out.reshape(grid.rows, grid.columns)
    if scan & 0x10:  # every other row backwards
        shape = shape.copy()
        shape[1::2] = shape[1::2, ::-1]
    return shape


@dataclass
class Share(InputPartition):
    path: str
    low: int
    high: int


class GribReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.tests = path, split, {}

    def pushFilters(self, filters):
        """Comparisons of a message's keys or of its axes with constants are taken, the others left."""
        self.tests = usable(filters, (*KEYS, "latitude", "longitude"))
        taken = [f for own in self.tests.values() for f in own]
        return [f for f in filters if not any(f is t for t in taken)]

    def partitions(self):
        return [Share(path, k, min(k + self.split, size)) for path, size in files(self.path, ENDINGS) for k in range(0, max(size, 1), self.split)]

    def read(self, partition: Share):
        read = Ranges(partition.path)
        try:
            yield from self.cells(read, partition.low, partition.high)
        finally:
            read.close()

    def _wanted(self, keys: dict) -> bool:
        for c, tests in self.tests.items():
            if c in keys:
                v = keys[c]
                if v is None or not passing(np.array([_micros(v) if isinstance(v, datetime) else v], object if isinstance(v, str) else None), tests)[0]:
                    return False
        return True

    def cells(self, read: Ranges, low: int, high: int):
        for m in messages(read, low, high):
            if not self._wanted(m.keys):
                continue
            y, x = m.grid.axes()
            rows, columns = (np.flatnonzero(passing(a, self.tests.get(c, []))) for a, c in ((y, "latitude"), (x, "longitude")))
            if not len(rows) or not len(columns):
                continue
            values = decode(read, m)[np.ix_(rows, columns)].ravel()
            n = len(values)
            keys = [_repeated(m.keys[f.name], f, n) for f in SCHEMA[:7]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.repeat(y[rows], len(columns))), pa.array(np.tile(x[columns], len(rows))), pa.array(values, mask=np.isnan(values))], names=SCHEMA.names)


def _micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _repeated(value, f: StructField, n: int) -> pa.Array:
    if isinstance(f.dataType, TimestampNTZType):
        return timestamps(np.full(n, _micros(value), np.int64))
    kind = {StringType: pa.string(), IntegerType: pa.int32(), LongType: pa.int64(), DoubleType: pa.float64()}[type(f.dataType)]
    return pa.nulls(n, kind) if value is None else pa.array(np.full(n, value), kind) if not isinstance(value, str) else pa.array([value] * n, kind)


class Grib(DataSource):
    """Format ``gridloom_grib``. Options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_grib"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> GribReader:
        return GribReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def grib_table(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All cells of a GRIB file or of a folder of them: the keys of their messages (step in
    microseconds), latitude, longitude (-180 to below 180) and value."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Grib)
    return spark.read.format("gridloom_grib").option("split_bytes", split_bytes).load(path)


def from_grib(spark: SparkSession, path: str, param: str, dims=("valid_time", "latitude", "longitude"), *, level: float | None = None, split_bytes: int = SPLIT_BYTES) -> Cube:
    """A cube of one parameter, of one level if asked; dims are keys of the messages and the axes.
    Values of messages that filters on these leave out aren't read."""
    df = grib_table(spark, path, split_bytes).filter(F.col("param") == param)
    df = df if level is None else df.filter(F.col("level") == float(level))
    return Cube.of(df.select(*dims, F.col("value").alias(param)), dims, [param])


_INDEX = "path string, offset long, length long, edition int, param string, level_type int, level double, forecast_reference_time timestamp_ntz, step long, valid_time timestamp_ntz, number int, rows int, columns int, bits int"


def message_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each field: where its message lies, its keys and the size of its grid. Ranges of bytes are
    gone through side by side; values aren't read."""
    shares = [(p, k, min(k + split_bytes, size)) for p, size in files(path, ENDINGS) for k in range(0, max(size, 1), split_bytes)]

    def run(batches):
        for batch in batches:
            for p, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = Ranges(p)
                rows = [{"path": p, "offset": m.offset, "length": m.length, "edition": m.edition, **m.keys, "rows": m.grid.rows, "columns": m.grid.columns, "bits": m.packing.bits} for m in messages(read, low, high)]
                read.close()
                kinds = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("edition", pa.int32()), ("param", pa.string()), ("level_type", pa.int32()), ("level", pa.float64()), ("forecast_reference_time", pa.timestamp("us"))]
                kinds += [("step", pa.int64()), ("valid_time", pa.timestamp("us")), ("number", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32()), ("bits", pa.int32())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return spark.createDataFrame(shares, "path string, low long, high long").repartition(max(1, len(shares))).mapInArrow(run, _INDEX)


# Writing, edition 2
def encode(values: np.ndarray, lats: np.ndarray, lons: np.ndarray, reference: datetime, *, hours: int = 0, parameter: tuple[int, int, int] = (0, 0, 0), level: tuple[int, float] = (1, 0.0), member: int | None = None, bits: int = 16, decimal: int = 0) -> bytes:
    """A message of a grid of rows by columns on evenly spaced axes; NaN is missing."""
    there = ~np.isnan(values.ravel())
    x = values.ravel()[there] * 10.0**decimal
    low = np.float32(x.min() if len(x) else 0)
    if len(x) and float(low) > x.min():
        low = np.nextafter(low, np.float32(-np.inf))
    span = float(x.max() - float(low)) if len(x) else 0.0
    binary = int(np.ceil(np.log2(span / ((1 << bits) - 1)))) if span > 0 else 0
    n = np.minimum(np.round((x - float(low)) / 2.0**binary), (1 << bits) - 1).astype(np.int64)
    packed = np.packbits(((n[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)).tobytes()

    def sign(v: int, size: int) -> bytes:
        return ((1 << (8 * size - 1) if v < 0 else 0) | abs(v)).to_bytes(size, "big")

    def section(k: int, body: bytes) -> bytes:
        return (len(body) + 5).to_bytes(4, "big") + bytes([k]) + body

    micro = lambda a: sign(round(float(a) * 1e6), 4)
    step = [round(abs(float(a[-1] - a[0])) / max(1, len(a) - 1) * 1e6) for a in (lons, lats)]
    time = reference.year.to_bytes(2, "big") + bytes([reference.month, reference.day, reference.hour, reference.minute, reference.second])
    grid = bytes([0]) + values.size.to_bytes(4, "big") + bytes(4) + bytes([6]) + bytes(15) + len(lons).to_bytes(4, "big") + len(lats).to_bytes(4, "big") + bytes(4) + b"\xff" * 4
    grid += micro(lats[0]) + micro(lons[0]) + bytes([48]) + micro(lats[-1]) + micro(lons[-1]) + step[0].to_bytes(4, "big") + step[1].to_bytes(4, "big") + bytes([0x40 if lats[-1] > lats[0] else 0])
    product = bytes(2) + (0 if member is None else 1).to_bytes(2, "big") + bytes([parameter[1], parameter[2], 2, 0, 0, 0, 0, 0, 1]) + sign(hours, 4) + bytes([level[0]]) + sign(3, 1) + sign(round(level[1] * 1000), 4) + b"\xff" * 6
    product += b"" if member is None else bytes([3, member, 0])
    sections = section(1, bytes(4) + bytes([0, 0, 1]) + time + bytes(2)) + section(3, grid) + section(4, product)
    sections += section(5, len(x).to_bytes(4, "big") + bytes(2) + struct.pack(">f", low) + sign(binary, 2) + sign(decimal, 2) + bytes([bits, 0]))
    sections += section(6, b"\xff" if there.all() else b"\0" + np.packbits(there).tobytes()) + section(7, packed)
    return b"GRIB" + bytes(2) + bytes([parameter[0], 2]) + (16 + len(sections) + 4).to_bytes(8, "big") + sections + b"7777"


def to_grib(cube: Cube, path: str, time: str, lat: str, lon: str, *, parameter: tuple[int, int, int] = (0, 0, 0), bits: int = 24, decimal: int = 0) -> None:
    """Write a cube of one variable on evenly spaced axes as a folder of files, a message for each time;
    absent cells are missing. The labels of the axes pass through the driver, a message's cells through
    one task. A task that is run again writes the same file anew."""
    (v,) = cube.vars
    axes = [np.array([r[0] for r in cube.df.select(F.col(c).cast("double").alias(c)).distinct().orderBy(c).collect()]) for c in (lat, lon)]
    lats, lons = axes
    if any(len(a) > 2 and not np.allclose(np.diff(a), a[1] - a[0]) for a in axes):
        raise ValueError("the axes are not evenly spaced")

    def run(batches):
        from pyspark import TaskContext

        from .ranges import store

        system, folder = store(path)
        out = None
        for batch in batches:
            for t, y, x, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.grib2")
                grid = np.full((len(lats), len(lons)), np.nan)
                grid[np.searchsorted(lats, y), np.searchsorted(lons, x)] = [np.nan if c is None else c for c in cells]
                out.write(encode(grid, lats, lons, t, parameter=parameter, bits=bits, decimal=decimal))
        if out is not None:
            out.close()
        yield from ()

    cells = cube.df.select(F.col(time).cast("timestamp_ntz").alias("t"), F.struct(F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"), F.col(v).cast("double").alias("v")).alias("c"))
    grouped = cells.groupBy("t").agg(F.collect_list("c").alias("c")).select("t", "c.y", "c.x", "c.v")
    grouped.mapInArrow(run, "nothing int").write.format("noop").mode("overwrite").save()
