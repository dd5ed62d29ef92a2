"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube, names


def from_parquet(spark: SparkSession, path: str, dims, variables=None, coords=()) -> Cube:
    """A cube of a Parquet table; only the columns named are read."""
    return Cube.of(spark.read.parquet(path), dims, variables, coords)


def from_csv(spark: SparkSession, path: str, schema: str, dims, variables=None, coords=()) -> Cube:
    return Cube.of(spark.read.csv(path, schema=schema, header=True), dims, variables, coords)


def from_wide(df: DataFrame, dims, columns: dict[str, object], dim: str, variable: str) -> Cube:
    """A cube of a table with a column per label of ``dim``: columns gives each one's label."""
    kept = names(dims)
    long = df.select(*kept, F.explode(F.array(*[F.struct(F.lit(x).alias(dim), F.col(c).alias(variable)) for c, x in columns.items()])).alias("x"))
    return Cube.of(long.select(*kept, f"x.{dim}", f"x.{variable}"), (*kept, dim), [variable])


_GEOMETRY = "struct<type:string,coordinates:string>"


def geojson(spark: SparkSession, path: str, properties: str = "") -> DataFrame:
    """A feature table of a GeoJSON file of polygons and multipolygons: the properties asked for
    (as 'name type, ...'), ``index`` (position in the file) and ``rings``, outer and inner alike."""
    wanted = f"struct<{properties.replace(' ', ':').replace(',:', ',')}>" if properties else "struct<>"
    schema = f"features array<struct<geometry:{_GEOMETRY},properties:{wanted}>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("index", "f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    raw = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = F.transform(raw, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return each.select(F.col("index").cast("long").alias("index"), *([F.col("f.properties.*")] if properties else []), rings.alias("rings"))


def to_parquet(cube: Cube, path: str, partition_by=(), mode: str = "errorifexists") -> None:
    """Write the long table, in folders by columns if asked; attributes of columns are kept."""
    cube.df.write.partitionBy(*names(partition_by)).mode(mode).parquet(path)


def to_array_rows(cube: Cube, dim) -> DataFrame:
    """One row per label of the other dimensions, variables as arrays along ``dim``, in order."""
    along = names(dim)
    keys = cube.without(*along)
    packed = [F.transform(F.array_sort(F.collect_list(F.struct(*along, F.col(v).alias("__v")))), lambda s: s["__v"]).alias(v) for v in cube.vars]
    return cube.df.groupBy(*keys).agg(*packed)
