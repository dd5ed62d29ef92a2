"""Cubes and features from files, and cubes to files."""

from .files import from_csv, from_parquet, from_wide, geojson, to_array_rows, to_parquet
from .grib import from_grib, grib_table, message_index, to_grib
from .netcdf import from_netcdf, to_netcdf

__all__ = ["from_csv", "from_grib", "from_netcdf", "from_parquet", "from_wide", "geojson", "grib_table", "message_index", "to_array_rows", "to_grib", "to_netcdf", "to_parquet"]
