"""Byte ranges of files in local or shared stores, and what the binary sources share."""

from __future__ import annotations

import re
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as ds

#: A partition reads about so many bytes of a file.
SPLIT_BYTES = 64 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of a URI that pyarrow knows (file, hdfs, s3, gs)."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of those in a folder that end so; hidden ones are left out."""
    system, at = store(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [x for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name.endswith(endings) and x.base_name[0] not in "._"]
    if not found:
        raise FileNotFoundError(f"no files that end in {', '.join(endings)} in {path}")
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.base_name)]


class Ranges:
    """Reads of byte ranges of one file; counts the bytes read."""

    def __init__(self, path: str):
        system, at = store(path)
        self.file = system.open_input_file(at)
        self.size, self.bytes_read = self.file.size(), 0

    def __call__(self, at: int, n: int) -> bytes:
        if not n:
            return b""
        self.file.seek(at)
        out = self.file.read(n)
        self.bytes_read += len(out)
        if len(out) < n:
            raise EOFError(f"{n} bytes at {at} of a file of {self.size}")
        return out

    def close(self) -> None:
        self.file.close()


_TESTS = {
    ds.EqualTo: lambda a, v: a == v,
    ds.GreaterThan: lambda a, v: a > v,
    ds.GreaterThanOrEqual: lambda a, v: a >= v,
    ds.LessThan: lambda a, v: a < v,
    ds.LessThanOrEqual: lambda a, v: a <= v,
    ds.In: lambda a, v: np.isin(a, v),
}


def comparable(value):
    """Timestamps as whole microseconds since 1970, anything else as it is."""
    if isinstance(value, (tuple, list)):
        return [comparable(v) for v in value]
    if isinstance(value, datetime):
        return round((value.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    if isinstance(value, date):
        return (value - date(1970, 1, 1)).days * 86_400_000_000
    return value


def usable(filters: list[ds.Filter], columns) -> dict[str, list[ds.Filter]]:
    """The comparisons with constants among filters, by those of the columns that they are about."""
    out: dict[str, list[ds.Filter]] = {}
    for f in filters:
        if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in columns:
            out.setdefault(f.attribute[0], []).append(f)
    return out


def passing(labels: np.ndarray, tests: list[ds.Filter]) -> np.ndarray:
    """Which labels pass all comparisons."""
    out = np.ones(len(labels), bool)
    for f in tests:
        out &= _TESTS[type(f)](labels, comparable(f.value))
    return out


def timestamps(micros: np.ndarray) -> pa.Array:
    return pa.array(micros.astype("datetime64[us]"), pa.timestamp("us"))
