"""Which column is which axis, and what the grid and the time axis are like."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cube import Cube

# CF standard names and common column names of each axis, in order of priority.
STANDARD_NAMES = {
    "y": ("projection_y_coordinate", "latitude", "grid_latitude"),
    "x": ("projection_x_coordinate", "longitude", "grid_longitude"),
    "t": ("time", "valid_time", "forecast_reference_time"),
    "realization": ("realization",),
}
KNOWN_NAMES = {
    "y": ("lat", "latitude"),
    "x": ("lon", "long", "longitude"),
    "t": ("time", "valid_time", "forecast_reference_time"),
    "realization": ("ensemble_member", "ensemble", "member", "number", "realization", "realisation"),
}


def find_axis(cube: Cube, axis: str, *, required: bool = False, coords: bool = False) -> str | None:
    """The column of an axis: by its ``axis`` attribute, its standard name, then its own name; among
    the dimensions and, if asked, the coordinates. None, or ValueError if required, if there is none."""
    for group in (cube.dims, cube.coords) if coords else (cube.dims,):
        meta = {c: cube.meta(c) for c in group}
        for c in group:
            if str(meta[c].get("axis", "")).lower() == axis.lower():
                return c
        for wanted, have in ((STANDARD_NAMES[axis], {c: meta[c].get("standard_name") for c in group}), (KNOWN_NAMES[axis], {c: c for c in group})):
            for name in wanted:
                for c in group:
                    if have[c] == name:
                        return c
    if required:
        raise ValueError(f"no dimension of axis {axis!r} among {cube.dims}")
    return None


def time_axis(cube: Cube, given: str | None = None) -> str:
    return given or find_axis(cube, "t", required=True, coords=True)


def evenly_spaced(values: list[float]) -> bool:
    """Whether all steps are close to the first; fewer than two values are."""
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    return all(math.isclose(s, steps[0], rel_tol=1e-5, abs_tol=1e-8) for s in steps)


def _spacing(cube: Cube, column: str) -> bool:
    """evenly_spaced of the column's distinct values, worked out by Spark."""
    step = F.col(column) - F.lag(column).over(Window.orderBy(column))
    row = cube.df.select(column).distinct().select(step.alias("s")).agg(F.min("s"), F.max("s")).first()
    return row[0] is None or math.isclose(row[0], row[1], rel_tol=1e-5, abs_tol=1e-8)


def spatial_info(cube: Cube, lat: str | None = None, lon: str | None = None) -> dict:
    """lat and lon columns, the dimensions they span and whether the grid is regular: latitude and
    longitude are dimensions of their own, each evenly spaced."""
    lat = lat or find_axis(cube, "y", required=True, coords=True)
    lon = lon or find_axis(cube, "x", required=True, coords=True)
    own = lat in cube.dims and lon in cube.dims
    dims = (lat, lon) if own else tuple(d for d in cube.dims if d != find_axis(cube, "t"))
    return {"lat": lat, "lon": lon, "spatial_dims": dims, "regular": own and _spacing(cube, lat) and _spacing(cube, lon)}


#: Names of frequencies with the shortest and longest step, in days.
_FREQUENCIES = (("hour", 1 / 24, 1 / 24), ("dayofyear", 1, 1), ("weekofyear", 7, 7), ("month", 28, 31), ("year", 365, 366))


def frequencies(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """(keys..., frequency): of each key's time labels, from the shortest and longest step between them; null
    where that is of no known frequency or there is no step."""
    at = F.col(time).cast("timestamp").cast("double") / 86400
    step = at - F.lag(at).over(Window.partitionBy(*keys).orderBy(time))
    ends = df.select(*keys, time).distinct().select(*keys, step.alias("s")).groupBy(*keys).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    found = F.lit(None).cast("string")
    for name, least, most in reversed(_FREQUENCIES):
        found = F.when((F.col("lo") >= least - 1e-9) & (F.col("hi") <= most + 1e-9), name).otherwise(found)
    return ends.select(*keys, found.alias("frequency"))


def infer_frequency(cube: Cube, time: str | None = None) -> str:
    """'hour', 'dayofyear', 'weekofyear', 'month' or 'year' from the steps between time labels."""
    t = time_axis(cube, time)
    (row,) = frequencies(cube.df, t).collect()
    if row.frequency is None:
        raise ValueError(f"the steps of {t!r} are of no known frequency, or it has fewer than two labels")
    return row.frequency
