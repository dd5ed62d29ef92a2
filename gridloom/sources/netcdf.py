"""NetCDF files of the classic formats (CDF-1, CDF-2, CDF-5) as a Spark data source.

Reading: a partition is a share of the labels of a file's first dimension. The header and the
coordinate variables are small; of the variables asked for only the hyperslab is read that the filters on
dimensions leave, as byte ranges. Cells come as Arrow batches.

Writing: a file for each run of labels of the first dimension, which is the record dimension. A task
holds the cells of one file.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..cube import Cube, names
from .ranges import SPLIT_BYTES, Ranges, files, passing, store, timestamps, usable

# Fixed values of the file format: types, tags, default fill values.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
DEFAULT_FILLS = {3: -32767, 4: -2147483647, 5: np.float32(9.969209968386869e36), 6: 9.969209968386869e36}
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000, "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": 86_400_000_000, "d": 86_400_000_000}

#: Cells of a batch; gaps between records that are read over.
BATCH, READ_OVER = 1 << 19, 1 << 11


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    attributes: dict
    kind: int
    begin: int
    record: bool

    @property
    def type(self) -> np.dtype:
        return np.dtype(KINDS[self.kind])


@dataclass
class Header:
    """Dimensions (name to size, in the order of the file), variables, and how records lie."""

    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    record_size: int = 0
    axes: dict[str, np.ndarray] = field(default_factory=dict)

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in v.dims)


class _Parser:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 4
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file" + (" (it is an HDF5 one)" if raw[:4] == b"\x89HDF" else ""))
        self.version = raw[3]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise EOFError
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "big")

    def count(self) -> int:
        return self.number(8 if self.version == 5 else 4)

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode("utf-8")

    def items(self, tag: int, one: Callable) -> list:
        found, n = self.number(), self.count()
        if n and found != tag:
            raise ValueError(f"tag {found} in place of {tag} in the header")
        return [one() for _ in range(n)]

    def attribute(self) -> tuple[str, object]:
        name, kind, n = self.name(), self.number(), self.count()
        raw = self.padded(n * np.dtype(KINDS[kind]).itemsize)
        if kind == 2:
            return name, raw.decode("utf-8", "replace").rstrip("\0")
        values = np.frombuffer(raw, KINDS[kind]).tolist()
        return name, values[0] if n == 1 else values


def _header(raw: bytes, size: int) -> Header:
    p = _Parser(raw)
    records = p.count()
    dims = p.items(DIMENSIONS, lambda: (p.name(), p.count()))
    attributes = dict(p.items(ATTRIBUTES, p.attribute))

    def variable():
        name, at = p.name(), [p.count() for _ in range(p.count())]
        own, kind, _ = dict(p.items(ATTRIBUTES, p.attribute)), p.number(), p.count()
        begin = p.number(4 if p.version == 1 else 8)
        return Variable(name, tuple(dims[k][0] for k in at), own, kind, begin, bool(at) and dims[at[0]][1] == 0)

    variables = {v.name: v for v in p.items(VARIABLES, variable)}
    out = Header(dict(dims), attributes, variables)
    own = [v for v in variables.values() if v.record]
    sizes = [v.type.itemsize * math.prod(out.shape(v)[1:]) for v in own]
    out.record_size = sizes[0] if len(own) == 1 else sum(n + -n % 4 for n in sizes)  # one alone isn't padded
    if records == (1 << (64 if p.version == 5 else 32)) - 1:  # streamed: as many as there are
        records = (size - min(v.begin for v in own)) // out.record_size if own else 0
    for d, n in dims:
        out.dims[d] = n or records
    return out


def read_header(read: Ranges) -> Header:
    n = 1 << 16
    while True:
        raw = read(0, min(n, read.size))
        try:
            return _header(raw, read.size)
        except EOFError:
            if n >= read.size:
                raise ValueError("the header is cut off") from None
            n *= 4


def slab(read: Ranges, header: Header, v: Variable, outer: tuple[int, int], second: tuple[int, int] | None = None) -> np.ndarray:
    """Raw values of a variable for a range of its first dimension and one of its second."""
    shape, item = header.shape(v), v.type.itemsize
    if not shape:
        return np.frombuffer(read(v.begin, item), v.type)[0]
    inner = shape[1:]
    stride = header.record_size if v.record else item * math.prod(inner)
    low, high = second if second and inner else (0, inner[0] if inner else 1)
    row = item * math.prod(inner[1:]) if inner else item
    first, n, many = low * row, (high - low) * row, outer[1] - outer[0]
    begin = v.begin + outer[0] * stride
    if n == stride:
        raw = read(begin, many * n)
    elif n and stride - n < READ_OVER:
        span = np.frombuffer(read(begin + first, (many - 1) * stride + n) if many else b"", np.uint8)
        raw = b"".join(span[k * stride : k * stride + n].tobytes() for k in range(many))
    else:
        raw = b"".join(read(begin + k * stride + first, n) for k in range(many))
    return np.frombuffer(raw, v.type).reshape(many, *((high - low, *inner[1:]) if inner else ()))


def unpacked(v: Variable, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and which are missing: fill values, missing_value, NaN; scaled and offset."""
    missing = np.zeros(raw.shape, bool)
    fills = [v.attributes.get("_FillValue", DEFAULT_FILLS.get(v.kind)), v.attributes.get("missing_value")]
    for f in fills:
        for one in f if isinstance(f, list) else [f]:
            if one is not None and not isinstance(one, str):
                missing |= raw == np.array(one).astype(v.type)
    if "scale_factor" in v.attributes or "add_offset" in v.attributes or v.type.kind == "f":
        values = raw.astype(np.float64) * float(v.attributes.get("scale_factor", 1)) + float(v.attributes.get("add_offset", 0)) if v.attributes.keys() & {"scale_factor", "add_offset"} else raw.astype(np.float64)
        missing |= np.isnan(values)
        return values, missing
    return raw.astype(np.int64), missing


# Coordinates
def _time_unit(v: Variable) -> tuple[int, datetime] | None:
    m = re.fullmatch(r"\s*([A-Za-z]+?)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T\s]+(\d+):(\d+)(?::(\d+)(?:\.(\d+))?)?)?\s*(?:Z|UTC|[+]?0+:?0*)?\s*", str(v.attributes.get("units", "")))
    unit = m and (m[1].lower() if m[1].lower() in UNITS else None)
    if not unit:
        return None
    micros = int((m[8] or "0").ljust(6, "0")[:6])
    return UNITS[unit], datetime(*(int(x or 0) for x in m.groups()[1:7]), micros)


_CALENDARS = {"noleap": "365", "365_day": "365", "all_leap": "366", "366_day": "366", "360_day": "360"}


def _own_calendar(days: str, start: datetime, micros: int) -> str:
    """A label in a calendar whose years are all alike, as text."""
    lengths = [30] * 12 if days == "360" else [31, 28 + (days == "366"), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    day, rest = divmod(micros + ((start.hour * 60 + start.minute) * 60 + start.second) * 1_000_000 + start.microsecond, 86_400_000_000)
    year, left = divmod(day + sum(lengths[: start.month - 1]) + start.day - 1, sum(lengths))
    month = 0
    while left >= lengths[month]:
        left -= lengths[month]
        month += 1
    clock = timedelta(microseconds=rest)
    return f"{start.year + year:04d}-{month + 1:02d}-{left + 1:02d} {clock.seconds // 3600:02d}:{clock.seconds // 60 % 60:02d}:{clock.seconds % 60:02d}"


def axis(header: Header, d: str, read: Ranges) -> np.ndarray:
    """Labels of a dimension: of its coordinate variable, else numbers from 0. Times are microseconds,
    those of other calendars text."""
    if d not in header.axes:
        v = header.variables.get(d)
        if v is None or v.dims != (d,) or v.kind == 2:
            header.axes[d] = np.arange(header.dims[d], dtype=np.int64)
        else:
            raw = slab(read, header, v, (0, header.dims[d]))
            header.axes[d] = _labels(v, unpacked(v, raw)[0])
    return header.axes[d]


def _labels(v: Variable, values: np.ndarray) -> np.ndarray:
    unit = _time_unit(v)
    if unit is None:
        return values
    size, start = unit
    calendar = str(v.attributes.get("calendar", "standard")).lower()
    micros = np.round(values * size).astype(np.int64) if values.dtype.kind == "f" else values * size
    if calendar in _CALENDARS:
        return np.array([_own_calendar(_CALENDARS[calendar], start, int(m)) for m in micros], object)
    if calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        return values.astype(np.float64)
    return (micros + round((start - datetime(1970, 1, 1)) / timedelta(microseconds=1))).astype("datetime64[us]")


_META = ("units", "standard_name", "long_name", "axis", "calendar")


def _meta(v: Variable | None, calendar_known: bool = False) -> dict:
    return {k: str(v.attributes[k]) for k in _META if v and k in v.attributes and not (calendar_known and k in ("units", "calendar"))}


def chosen(header: Header, wanted: list[str] | None) -> tuple[tuple[str, ...], list[Variable]]:
    """Dimensions and variables of the table: the variables asked for, or all numeric ones with as
    many dimensions as any. Those of fewer dimensions repeat along the others."""
    grids = [v for v in header.variables.values() if v.kind != 2 and v.dims and v.dims != (v.name,)]
    if wanted:
        if unknown := [n for n in wanted if n not in header.variables]:
            raise KeyError(f"no variables {unknown} among {[v.name for v in grids]}")
        picked = [header.variables[n] for n in wanted]
    else:
        most = max((len(v.dims) for v in grids), default=0)
        widest = next((v.dims for v in grids if len(v.dims) == most), ())
        picked = [v for v in grids if v.dims == widest]
    if not picked:
        raise ValueError("no variables on a grid")
    dims = max((v.dims for v in picked), key=len)
    for v in picked:
        if [d for d in dims if d in v.dims] != list(v.dims):
            raise ValueError(f"{v.name} on {v.dims} doesn't go with {dims}: choose variables that do")
    return dims, picked


def _kind(values: np.ndarray) -> DataType:
    if values.dtype.kind == "M":
        return TimestampNTZType()
    return StringType() if values.dtype.kind == "O" else LongType() if values.dtype.kind in "iu" else DoubleType()


def _value_type(v: Variable) -> DataType:
    return DoubleType() if v.type.kind == "f" or v.attributes.keys() & {"scale_factor", "add_offset"} else LongType()


@dataclass
class Share(InputPartition):
    """The share k of n of a file's labels."""

    path: str
    k: int
    n: int


class NetcdfReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, wanted: list[str] | None, split: int):
        self.schema, self.path, self.wanted, self.split = schema, path, wanted, split
        self.tests: dict = {}

    def pushFilters(self, filters):
        """Comparisons of dimensions with constants are taken; the others are left to Spark."""
        kinds = {f.name: f.dataType for f in self.schema}
        self.tests = {c: t for c, t in usable(filters, self._dims()).items() if not isinstance(kinds[c], StringType)}
        taken = [f for own in self.tests.values() for f in own]
        return [f for f in filters if not any(f is t for t in taken)]

    def _dims(self) -> tuple[str, ...]:
        read = Ranges(files(self.path, (".nc",))[0][0])
        dims, _ = chosen(read_header(read), self.wanted)
        read.close()
        return dims

    def partitions(self):
        out = []
        for path, size in files(self.path, (".nc",)):
            n = max(1, -(-size // self.split))
            out += [Share(path, k, n) for k in range(n)]
        return out

    def read(self, partition: Share):
        read = Ranges(partition.path)
        try:
            yield from self.cells(read, partition.k, partition.n)
        finally:
            read.close()

    def cells(self, read: Ranges, k: int, n: int):
        header = read_header(read)
        dims, variables = chosen(header, self.wanted)
        labels = {d: axis(header, d, read) for d in dims}
        kept = {d: np.flatnonzero(passing(labels[d].astype(np.int64) if labels[d].dtype.kind == "M" else labels[d], self.tests.get(d, []))) for d in dims}
        size = len(labels[dims[0]])
        own = kept[dims[0]]
        own = own[(own >= size * k // n) & (own < size * (k + 1) // n)]
        inner = [kept[d] for d in dims[1:]]
        if not len(own) or not all(map(len, inner)):
            return
        step = max(1, BATCH // max(1, math.prod(map(len, inner))))
        runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
        for run in runs:
            for a in range(0, len(run), step):
                yield self._batch(read, header, dims, variables, labels, run[a : a + step], inner)

    def _batch(self, read, header, dims, variables, labels, outer, inner):
        picks = {dims[0]: outer, **dict(zip(dims[1:], inner, strict=True))}
        shape = tuple(len(picks[d]) for d in dims)
        columns = []
        for i, d in enumerate(dims):
            at = np.broadcast_to(picks[d].reshape([-1 if j == i else 1 for j in range(len(dims))]), shape).ravel()
            columns.append(_column(labels[d][at], None))
        for v in variables:
            if v.dims[:1] == dims[:1]:
                second = picks[v.dims[1]] if len(v.dims) > 1 else None
                bounds = (int(second[0]), int(second[-1]) + 1) if second is not None else None
                raw = slab(read, header, v, (int(outer[0]), int(outer[-1]) + 1), bounds)
                where = [picks[v.dims[0]] - outer[0], *([second - second[0]] if second is not None else []), *(picks[d] for d in v.dims[2:])]
            else:
                raw = slab(read, header, v, (0, header.dims[v.dims[0]]))
                where = [picks[d] for d in v.dims]
            values, missing = unpacked(v, raw[np.ix_(*where)])
            full = [len(picks[d]) if d in v.dims else 1 for d in dims]
            columns.append(_column(*(np.broadcast_to(x.reshape(full), shape).ravel() for x in (values, missing))))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def _column(values: np.ndarray, missing: np.ndarray | None) -> pa.Array:
    if values.dtype.kind == "M":
        return timestamps(values)
    if values.dtype.kind == "O":
        return pa.array(values.tolist(), pa.string())
    return pa.array(values.astype(np.float64 if values.dtype.kind == "f" else np.int64), mask=missing)


class Netcdf(DataSource):
    """Format ``gridloom_netcdf``. Options: path; variables, comma-separated; split_bytes; for writing those
    that ``to_netcdf`` sets."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_netcdf"

    def _wanted(self) -> list[str] | None:
        return [x for x in self.options.get("variables", "").split(",") if x] or None

    def schema(self) -> StructType:
        read = Ranges(files(self.options["path"], (".nc",))[0][0])
        header = read_header(read)
        dims, variables = chosen(header, self._wanted())
        fields = []
        for d in dims:
            kind, v = _kind(axis(header, d, read)), header.variables.get(d)
            fields.append(StructField(d, kind, False, _meta(v, isinstance(kind, TimestampNTZType))))
        read.close()
        return StructType(fields + [StructField(v.name, _value_type(v), True, _meta(v)) for v in variables])

    def reader(self, schema: StructType) -> NetcdfReader:
        return NetcdfReader(schema, self.options["path"], self._wanted(), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(schema, self.options["path"], json.loads(self.options["plan"]))


def from_netcdf(spark: SparkSession, path: str, variables=None, split_bytes: int = SPLIT_BYTES) -> Cube:
    """A cube of a NetCDF file, or of a folder of such files of the same variables. Only the variables
    named are read, and of those what filters on dimensions leave. Packed values are unpacked, missing ones
    null; times become timestamps, or text in calendars that Spark doesn't know."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Netcdf)
    df = spark.read.format("gridloom_netcdf").option("variables", ",".join(names(variables))).option("split_bytes", split_bytes).load(path)
    read = Ranges(files(path, (".nc",))[0][0])
    header = read_header(read)
    dims, _ = chosen(header, list(names(variables)) or None)
    read.close()
    return Cube.of(df, dims, attrs={k: v for k, v in header.attributes.items()})


# Writing
@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


def _name(s: str) -> bytes:
    raw = s.encode("utf-8")
    return raw + b"\0" * (-len(raw) % 4)


class _Layout:
    """The bytes of a header, and where variables begin."""

    def __init__(self, version: int):
        self.version = version

    def count(self, n: int) -> bytes:
        return n.to_bytes(8 if self.version == 5 else 4, "big")

    def named(self, s: str) -> bytes:
        return self.count(len(s.encode("utf-8"))) + _name(s)

    def listed(self, tag: int, items: list[bytes]) -> bytes:
        return (tag if items else 0).to_bytes(4, "big") + self.count(len(items)) + b"".join(items)

    def attributes(self, values: dict) -> bytes:
        out = []
        for k, v in values.items():
            raw, kind, n = (v.encode("utf-8"), 2, len(v.encode("utf-8"))) if isinstance(v, str) else (np.array(v, ">f8").tobytes(), 6, 1)
            out.append(self.named(k) + kind.to_bytes(4, "big") + self.count(n) + raw + b"\0" * (-len(raw) % 4))
        return self.listed(ATTRIBUTES, out)

    def header(self, records: int, dims: dict[str, int], attributes: dict, variables: list[tuple[str, tuple[str, ...], dict]]) -> tuple[bytes, list[int]]:
        """All variables are doubles; the first of dims is the record dimension."""
        first, at = next(iter(dims)), {d: k for k, d in enumerate(dims)}
        sizes = [8 * math.prod(dims[d] for d in own if d != first) for _, own, _ in variables]

        def build(begins: list[int]) -> bytes:
            entries = []
            for (name, own, meta), size, begin in zip(variables, sizes, begins, strict=True):
                ids = b"".join(self.count(at[d]) for d in own)
                vsize = self.count(min(size, (1 << (64 if self.version == 5 else 32)) - 4))
                entries.append(self.named(name) + self.count(len(own)) + ids + self.attributes(meta) + (6).to_bytes(4, "big") + vsize + begin.to_bytes(4 if self.version == 1 else 8, "big"))
            shapes = self.listed(DIMENSIONS, [self.named(d) + self.count(0 if d == first else n) for d, n in dims.items()])
            return b"CDF" + bytes([self.version]) + self.count(records) + shapes + self.attributes(attributes) + self.listed(VARIABLES, entries)

        place = len(build([0] * len(variables)))
        begins = [0] * len(variables)
        for fixed in (True, False):  # records come last
            for k, (_, own, _) in enumerate(variables):
                if (first not in own) == fixed:
                    begins[k] = place
                    place += sizes[k]
        return build(begins), begins


class NetcdfWriter(DataSourceArrowWriter):
    """Rows come sorted by file number and record label; a file holds whole records."""

    def __init__(self, schema: StructType, path: str, plan: dict):
        self.schema, self.path, self.plan = schema, path, plan

    def write(self, iterator):
        at, rows, moves = None, [], []
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            numbers = table["__file"].to_numpy()
            for lo, hi in zip(*(lambda c: ([0, *c], [*c, len(numbers)]))((np.flatnonzero(np.diff(numbers)) + 1).tolist()), strict=True):
                if lo == hi:
                    continue
                if at is not None and numbers[lo] != at:
                    moves.append(self._file(at, rows))
                    rows = []
                at = int(numbers[lo])
                rows.append(table.slice(lo, hi - lo))
        if rows:
            moves.append(self._file(at, rows))
        return Written(moves)

    def _file(self, number: int, rows: list[pa.Table]) -> tuple[str, str]:
        table, plan = pa.concat_tables(rows), self.plan
        (first, *inner), variables = plan["dims"], plan["variables"]
        records, which = np.unique(_numbers(table[first]), return_inverse=True)
        axes = {d: np.array(plan["axes"][d], np.float64) for d in inner}
        place = which
        for d in inner:
            place = place * len(axes[d]) + np.searchsorted(axes[d], _numbers(table[d]))
        grids = []
        for v in variables:
            grid = np.full(len(records) * math.prod(map(len, axes.values())), np.nan)
            grid[place] = table[v].cast(pa.float64()).to_numpy()
            grids.append(grid.reshape(len(records), -1).astype(">f8"))
        dims = {first: len(records), **{d: len(axes[d]) for d in inner}}
        listed = [(d, (d,), plan["meta"].get(d, {})) for d in plan["dims"]] + [(v, tuple(plan["dims"]), {"_FillValue": float("nan"), **plan["meta"].get(v, {})}) for v in variables]
        head, _ = _Layout(plan["version"]).header(len(records), dims, plan["attributes"], listed)
        system, folder = store(self.path)
        part = f"{folder.rstrip('/')}/_part-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(part) as out:
            out.write(head + b"".join(axes[d].astype(">f8").tobytes() for d in inner))
            labels = records.astype(">f8")
            for k in range(len(labels)):
                out.write(labels[k : k + 1].tobytes() + b"".join(g[k].tobytes() for g in grids))
        return part, f"{folder.rstrip('/')}/part-{number:06d}.nc"

    def commit(self, messages):
        system, _ = store(self.path)
        for m in messages:
            for part, final in m.moves if m else []:
                system.move(part, final)

    def abort(self, messages):
        system, _ = store(self.path)
        for m in messages:
            for part, _ in m.moves if m else []:
                system.delete_file(part)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Labels as doubles, times as seconds since 1970."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() / 1e6
    return column.cast(pa.float64()).to_numpy()


def to_netcdf(cube: Cube, path: str, version: int = 2, file_bytes: int = SPLIT_BYTES) -> None:
    """Write a folder of NetCDF files, the cells of runs of labels of the first dimension in each. Dimensions are
    numbers or times; absent cells and nulls are NaN. The labels of the other dimensions, which every
    file holds, pass through the driver."""
    from ..operators.reduce import dense_index

    first, *inner = cube.dims
    kinds = {f.name: f.dataType.typeName() for f in cube.df.schema}
    if text := [d for d in cube.dims if kinds[d] not in ("timestamp", "timestamp_ntz", "double", "float", "long", "integer", "short", "byte", "date")]:
        raise ValueError(f"labels that are neither numbers nor times: {text}")
    seconds = {d for d in cube.dims if kinds[d].startswith("timestamp")}

    def number(d: str):
        return (F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(d).cast("timestamp_ntz")) / 1e6 if d in seconds else F.col(d).cast("double")).alias(d)

    axes = {d: [r[0] for r in cube.df.select(number(d)).distinct().orderBy(d).collect()] for d in inner}
    record = 8 * len(cube.vars) * math.prod(map(len, axes.values()))
    per_file = max(1, file_bytes // max(record, 1))
    meta = {c: {k: str(v) for k, v in cube.meta(c).items() if k in _META} for c in (*cube.dims, *cube.vars)}
    for d in seconds:
        meta[d] |= {"units": "seconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}
    plan = {"dims": list(cube.dims), "variables": list(cube.vars), "axes": axes, "meta": meta, "version": version, "attributes": {k: v for k, v in cube.attrs.items() if isinstance(v, str)}}
    numbered = dense_index(cube.df, first).select(first, F.floor(F.col("__index") / per_file).cast("long").alias("__file"))
    rows = cube.df.select(*cube.dims, *cube.vars).join(numbered, first).select(*cube.dims, *cube.vars, "__file")
    spark = cube.df.sparkSession
    spark.dataSource.register(Netcdf)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__file").sortWithinPartitions("__file", first)
    dealt.write.format("gridloom_netcdf").option("plan", json.dumps(plan)).mode("append").save(path)
