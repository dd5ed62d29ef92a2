"""Further queries: sources and sinks, less usual statistics, attributes, detection, streams."""

from __future__ import annotations

import json
from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..detect import frequencies, spatial_info
from ..functions.periods import Period
from ..operators import climatology, ensemble, rates, spatial, temporal
from ..operators import reduce as core
from ..operators.partial import Partial
from ..shared import shared_path
from ..sources import from_csv, from_grib, from_netcdf, from_parquet, from_wide, geojson, message_index, to_grib, to_netcdf, to_parquet
from ..streaming import deaccumulate_stream, resample_stream, rolling_stream
from .queries import _BOXES, _GRID, _W, _daily_grid, _regions, agg_sql, by_type, daily_events, events, gridded, hourly_totals, orders, query, tidy

_DAILY = "(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL)"
#: Daily sums of which those under a bound are missing; an absent day is one already.
_HOLES = "(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, CASE WHEN sum(value) > 120 THEN sum(value) END AS v FROM events GROUP BY ALL)"


def holes(spark: SparkSession, sf_dir: str) -> Cube:
    cube = daily_events(spark, sf_dir)
    return cube.with_df(cube.df.withColumn("value", F.when(F.col("value") > 120, F.col("value"))))


# Sources and sinks
@query("SELECT event_type, round(avg(value) + 1e-8, 6) AS value FROM events GROUP BY event_type")
def source_parquet(spark, sf_dir):
    cube = from_parquet(spark, f"{sf_dir}/events.parquet", ("event_type", "event_id"), ["value"])
    return tidy(core.reduce(cube, "mean", dim="event_id"))


@query("SELECT event_type, round(max(value) + 1e-8, 6) AS value FROM events GROUP BY event_type")
def source_csv(spark, sf_dir):
    path = shared_path(spark, "csv")
    by_type(spark, sf_dir).df.select("event_type", "event_id", "value").write.csv(path, header=True)
    return tidy(core.reduce(from_csv(spark, path, "event_type string, event_id long, value double", ("event_type", "event_id")), "max", dim="event_id"))


@query("SELECT kind, round(sum(x) + 1e-8, 6) AS x FROM (SELECT 'id' AS kind, (event_id % 10)::DOUBLE AS x FROM events UNION ALL SELECT 'value', value FROM events) GROUP BY ALL")
def source_wide(spark, sf_dir):
    wide = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", (F.col("event_id") % 10).cast("double").alias("digit"))
    return tidy(core.reduce(from_wide(wide, "event_id", {"digit": "id", "value": "value"}, "kind", "x"), "sum", dim="event_id"))


@query(f"SELECT event_type, t, round(v + 1e-8, 6) AS value FROM {_DAILY}")
def sink_parquet(spark, sf_dir):
    path = shared_path(spark, "cube")
    to_parquet(daily_events(spark, sf_dir), path, partition_by="event_type")
    return tidy(Cube.of(spark.read.parquet(path).select("event_type", "ts", "value"), ("event_type", "ts")))


def grid_by_day(spark: SparkSession, sf_dir: str) -> Cube:
    cells = gridded(spark, sf_dir)
    return core.resample(cells, "D", "sum", time_dim="ts", extra_reduce_dims=("event_type", "event_id"))


#: Days from the tenth on, and the rows of the northern half.
_NORTH_LATER = f"SELECT lat, date_trunc('day', ts)::TIMESTAMP AS t, round(sum(value) + 1e-8, 6) AS value FROM {_GRID} WHERE lat >= 0 AND ts >= TIMESTAMP '2024-01-10' GROUP BY ALL"


@query(_NORTH_LATER)
def source_netcdf(spark, sf_dir):
    """The daily grid as NetCDF files, read back as far as filters on its dimensions leave."""
    path = shared_path(spark, "netcdf")
    daily = grid_by_day(spark, sf_dir)
    to_netcdf(Cube(daily.df, ("ts", "lat", "lon"), daily.vars), path)
    cube = from_netcdf(spark, path, "value")
    some = cube.with_df(cube.df.filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("lat") >= 0) & F.col("value").isNotNull()))
    return tidy(core.reduce(some, "sum", dim="lon"))


@query(f"SELECT lat AS latitude, t, round(max(v), 2) AS tp FROM (SELECT lat, lon, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM {_GRID} WHERE lat >= 0 AND ts >= TIMESTAMP '2024-01-10' GROUP BY ALL) GROUP BY ALL")
def source_grib(spark, sf_dir):
    """The daily grid as GRIB messages, read back as far as filters on time and rows leave. Values are
    sums of hundredths, which 31 bits and two decimals hold."""
    path = shared_path(spark, "grib")
    to_grib(grid_by_day(spark, sf_dir), path, "ts", "lat", "lon", parameter=(0, 1, 8), bits=31, decimal=2)
    cube = from_grib(spark, path, "tp")
    some = cube.with_df(cube.df.filter((F.col("valid_time") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("latitude") >= 0) & F.col("tp").isNotNull()))
    out = core.reduce(some, "max", dim="longitude").df
    return out.select("latitude", F.col("valid_time").alias("t"), F.round("tp", 2).alias("tp"))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS valid_time, 'tp' AS param, 19 AS rows, 36 AS columns FROM {_GRID} GROUP BY ALL")
def grib_index(spark, sf_dir):
    path = shared_path(spark, "grib")
    to_grib(core.reduce(_whole_grid(spark, sf_dir), "sum", dim="event_type"), path, "ts", "lat", "lon", parameter=(0, 1, 8))
    return message_index(spark, path).select("valid_time", "param", "rows", "columns")


def _whole_grid(spark: SparkSession, sf_dir: str) -> Cube:
    """The daily grid with a cell in each corner, so that its axes are whole."""
    daily = core.resample(gridded(spark, sf_dir), "D", "sum", time_dim="ts", extra_reduce_dims="event_id")
    every = spark.range(19).select((F.col("id") * 10 - 90).cast("double").alias("lat")).crossJoin(F.broadcast(spark.range(36).select((F.col("id") * 10 - 180).cast("double").alias("lon"))))  # 684 rows
    first = daily.df.groupBy("event_type").agg(F.min("ts").alias("ts"))
    return daily.with_df(daily.df.select("event_type", "ts", "lat", "lon", "value").unionByName(first.crossJoin(F.broadcast(every)).withColumn("value", F.lit(0.0))))


@query(f"SELECT region, round(avg(value) + 1e-8, 6) AS value FROM {_BOXES} LEFT JOIN (SELECT lat, lon, sum(value) AS value FROM {_GRID} GROUP BY ALL) ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY ALL")
def source_geojson(spark, sf_dir):
    def ring(x0, y0, x1, y1):
        return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]

    shapes = {"north": ("Polygon", [ring(-95, 5, 95, 65)]), "south": ("MultiPolygon", [[ring(-185, -85, 55, -15)]]), "none": ("Polygon", [ring(171, 71, 174, 74)])}
    found = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"region": n}, "geometry": {"type": kind, "coordinates": at}} for n, (kind, at) in shapes.items()]}
    path = shared_path(spark, "geojson")
    spark.createDataFrame([(json.dumps(found),)], "value string").write.text(path)
    return tidy(spatial.reduce(_daily_grid(spark, sf_dir), geojson(spark, path, "region string"), "mean", mask_dim="region"))


@query(f"SELECT region, label, round(max(value) + 1e-8, 6) AS value FROM {_BOXES} LEFT JOIN (SELECT lat, lon, sum(value) AS value FROM {_GRID} GROUP BY ALL) ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 JOIN (VALUES ('north', 'n'), ('south', 's'), ('none', '-')) l(region, label) USING (region) GROUP BY ALL")
def table_expanded(spark, sf_dir):
    table = _regions(spark).withColumn("label", F.when(F.col("region") == "none", "-").otherwise(F.left("region", F.lit(1))))
    return tidy(spatial.reduce(_daily_grid(spark, sf_dir), table, "max", mask_dim="region", expanded=True)).drop("rings")


@query(f"SELECT 0::BIGINT AS index, round(avg(value) + 1e-8, 6) AS value FROM (SELECT lat, lon, sum(value) AS value FROM {_GRID} GROUP BY ALL)")
def table_without_features(spark, sf_dir):
    return tidy(spatial.reduce(_daily_grid(spark, sf_dir), how="mean", expanded=True))


@query(f"SELECT region, 4::BIGINT AS corners, round(sum(coalesce(value, 0)) + 1e-8, 6) AS value FROM {_BOXES} LEFT JOIN {_GRID} ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY ALL")
def geometry_as_coordinate(spark, sf_dir):
    out = spatial.reduce(_daily_grid(spark, sf_dir), _regions(spark), "sum", mask_dim="region", return_geometry_as_coord=True)
    return tidy(out).select("region", F.size(F.flatten("geometry")).cast("long").alias("corners"), "value")


@query(f"SELECT k.index, round(min(value) + 1e-8, 6) AS value FROM (SELECT lat, lon, sum(value) AS value FROM {_GRID} GROUP BY ALL) JOIN (VALUES (0::BIGINT, -95, 5, 95, 65), (1::BIGINT, -185, -85, 55, -15)) k(index, x0, y0, x1, y1) ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY ALL")
def zonal_by_number(spark, sf_dir):
    table = spatial.features(spark, [(0, spatial.box(-95, 5, 95, 65)), (1, spatial.box(-185, -85, 55, -15))], "index").select("rings")
    return tidy(spatial.reduce(_daily_grid(spark, sf_dir), table.coalesce(1), "min"))


@query(f"SELECT round(avg(value) + 1e-8, 6) AS value FROM {_GRID} WHERE event_type = 'click'")
def squeezed(spark, sf_dir):
    cube = gridded(spark, sf_dir)
    return tidy(spatial.reduce(cube.with_df(cube.df.filter("event_type = 'click'")), how="mean", extra_reduce_dims=("event_id", "ts"), squeeze=True))


# Missing cells
@query(f"SELECT event_type, t, round(v + 1e-8, 6) AS value FROM {_HOLES} WHERE event_type IN (SELECT event_type FROM {_HOLES} GROUP BY event_type HAVING count(v) = (SELECT count(DISTINCT t) FROM {_HOLES}))")
def dropna_any(spark, sf_dir):
    return tidy(core.drop_missing(holes(spark, sf_dir), "event_type", "any"))


@query(f"SELECT t, round(max(v) + 1e-8, 6) AS value FROM (SELECT t, CASE WHEN v > 200 THEN v END AS v FROM {_DAILY}) GROUP BY t HAVING count(v) > 0")
def reduce_dropna_all(spark, sf_dir):
    cube = daily_events(spark, sf_dir)
    return tidy(core.reduce(cube.with_df(cube.df.withColumn("value", F.when(F.col("value") > 200, F.col("value")))), "max", dim="event_type", how_dropna="all"))


for _name, _how, _options in (("strict_mean", "numpy.mean", {}), ("skipna_false", "mean", {"skipna": False})):

    @query(f"SELECT t, round(CASE WHEN count(v) = count(*) THEN avg(v) END + 1e-8, 6) AS value FROM {_HOLES} GROUP BY t", f"reduce_{_name}")
    def _(spark, sf_dir, how=_how, options=_options):
        return tidy(core.reduce(holes(spark, sf_dir), how, dim="event_type", **options))


@query(f"SELECT t, round(max(v) + 1e-8, 6) AS value FROM {_HOLES} GROUP BY t")
def reduce_by_path(spark, sf_dir):
    return tidy(core.reduce(holes(spark, sf_dir), "numpy.nanmax", dim="event_type"))


# Other statistics
_ONCE = f"(SELECT event_type, t, v, row_number() OVER (PARTITION BY event_type ORDER BY t) AS n, dense_rank() OVER (ORDER BY t) - 1 AS i FROM {_DAILY})"
for _how, _sql in {
    "last": "round(arg_max(v, t) + 1e-8, 6)",
    "idxmin": "arg_min(t, v)",
    "idxmax": "arg_max(t, v)",
    "argmin": "arg_min(i, v)",
    "argmax": "arg_max(i, v)",
    "any": "bool_or(v <> 0)",
    "every": "bool_and(v <> 0)",
}.items():

    @query(f"SELECT event_type, {_sql} AS value FROM {_ONCE} GROUP BY event_type", f"reduce_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(core.reduce(daily_events(spark, sf_dir), {"every": "all"}.get(how, how), dim="ts"))


@query(f"SELECT event_type, round(product(1 + v / 1e6) + 1e-8, 6) AS value FROM {_DAILY} GROUP BY event_type")
def reduce_prod(spark, sf_dir):
    cube = daily_events(spark, sf_dir)
    return tidy(core.reduce(cube.with_df(cube.df.withColumn("value", 1 + F.col("value") / 1e6)), "prod", dim="ts"))


@query(f"SELECT event_type, t, round(sum(v) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) + 1e-8, 6) AS value FROM {_DAILY}")
def reduce_cumsum(spark, sf_dir):
    return tidy(core.reduce(daily_events(spark, sf_dir), "cumsum", dim="ts"))


@query(f"SELECT event_type, t, round(exp(sum(ln(1 + v / 1e6)) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING)) + 1e-8, 6) AS value FROM {_DAILY}")
def reduce_cumprod(spark, sf_dir):
    cube = daily_events(spark, sf_dir)
    return tidy(core.reduce(cube.with_df(cube.df.withColumn("value", 1 + F.col("value") / 1e6)), "cumprod", dim="ts"))


@query(f"SELECT event_type, round(stddev_samp(v) + 1e-8, 6) AS value FROM {_DAILY} GROUP BY event_type")
def reduce_ddof(spark, sf_dir):
    return tidy(core.reduce(daily_events(spark, sf_dir), "std", dim="ts", ddof=1))


@query(f"SELECT event_type, round(sum({_W}) + 1e-8, 6) AS value FROM {_GRID} GROUP BY ALL")
def weighted_sum_of_weights(spark, sf_dir):
    return tidy(core.reduce(gridded(spark, sf_dir), "sum_of_weights", dim=("event_id", "ts", "lat", "lon"), weights="latitude"))


@query(f"WITH g AS {_GRID}, m AS (SELECT event_type, sum({_W} * value) / sum({_W}) AS m FROM g GROUP BY ALL) SELECT event_type, round(sum({_W} * (value - m) ^ 2) + 1e-8, 6) AS value FROM g JOIN m USING (event_type) GROUP BY ALL")
def weighted_sum_of_squares(spark, sf_dir):
    return tidy(core.reduce(gridded(spark, sf_dir), "sum_of_squares", dim=("event_id", "ts", "lat", "lon"), weights="latitude"))


@query("SELECT event_type, round(quantile_cont(value, 0.25) + 1e-8, 6) AS value FROM events GROUP BY event_type")
def weighted_quantile(spark, sf_dir):
    cube = by_type(spark, sf_dir)
    same = cube.df.select("event_type").distinct().withColumn("w", F.lit(2.0))
    return tidy(core.reduce(cube, "quantile", dim=("event_id", "ts"), weights=same, q=0.25))


def _spread(x, axis=None):
    return np.nanmax(x, axis=axis) - np.nanmin(x, axis=axis)


@query(f"SELECT event_type, t, round(CASE WHEN count(v) OVER w = 3 THEN max(v) OVER w - min(v) OVER w END + 1e-8, 6) AS value FROM {_ONCE} WINDOW w AS (PARTITION BY event_type ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_function(spark, sf_dir):
    return tidy(core.rolling_reduce(daily_events(spark, sf_dir), _spread, ts=3))


# Time
@query("SELECT date_trunc('day', ts)::TIMESTAMP AS t, round(avg(value) + 1e-8, 6) AS value FROM events GROUP BY ALL")
def daily_by_coordinate(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("2024-01-01").cast("timestamp_ntz").alias("forecast_reference_time"), F.col("event_id").alias("step"), F.col("ts").alias("valid_time"), "value")
    cube = Cube.of(df, ("forecast_reference_time", "step"), ["value"], ("valid_time",))
    return tidy(temporal.daily_mean(cube, time_dim="valid_time")).withColumnRenamed("valid_time", "t")


@query("SELECT (event_id % 5)::BIGINT AS day, round(avg(value) + 1e-8, 6) AS value FROM events GROUP BY ALL")
def daily_of_spans(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(((F.col("event_id") % 5) * 86_400_000_000 + F.col("event_id") % 1000).alias("time"), "event_id", "value")
    return tidy(temporal.daily_mean(Cube.of(df, ("event_id", "time"), ["value"]), extra_reduce_dims="event_id")).withColumnRenamed("time", "day")


@query("SELECT date_trunc('month', ts)::TIMESTAMP + INTERVAL 14 DAY AS t, event_type, round(sum(value) + 1e-8, 6) AS value FROM events GROUP BY ALL")
def standardised_time(spark, sf_dir):
    cube = temporal.monthly_sum(by_type(spark, sf_dir), time_dim="ts", extra_reduce_dims="event_id")
    return tidy(temporal.standardise_time(cube, "%Y-%m-15", time_dim="ts"))


#: Labels by day, week, month and quarter for the orders of each priority, and as they are for the last.
_PACE = {"1-URGENT": ("D", "date_trunc('day', o_orderdate)"), "2-HIGH": ("W", "date_trunc('week', o_orderdate) + INTERVAL 6 DAY"), "3-MEDIUM": ("MS", "date_trunc('month', o_orderdate)"), "4-NOT SPECIFIED": ("YE", "make_date(year(o_orderdate), 12, 31)")}


@query(
    f"""WITH o AS (SELECT o_orderpriority, CASE {' '.join(f"WHEN o_orderpriority = '{p}' THEN {e}" for p, (_, e) in _PACE.items())} ELSE o_orderdate END::TIMESTAMP AS t FROM orders),
l AS (SELECT DISTINCT o_orderpriority, t FROM o), s AS (SELECT o_orderpriority, date_diff('day', lag(t) OVER (PARTITION BY o_orderpriority ORDER BY t), t) AS d FROM l)
SELECT o_orderpriority, CASE WHEN min(d) = 1 AND max(d) = 1 THEN 'dayofyear' WHEN min(d) = 7 AND max(d) = 7 THEN 'weekofyear' WHEN min(d) >= 28 AND max(d) <= 31 THEN 'month' WHEN min(d) >= 365 AND max(d) <= 366 THEN 'year' END AS frequency FROM s GROUP BY ALL"""
)
def inferred_frequency(spark, sf_dir):
    """Of each priority's labels, which are put at its own pace."""
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    label = F.col("t")
    for priority, (code, _) in _PACE.items():
        label = F.when(F.col("o_orderpriority") == priority, Period.parse(code).label(F.col("t"))).otherwise(label)
    return frequencies(cells.select("o_orderpriority", label.alias("t")), "t", "o_orderpriority")


# Anomalies, attributes
@query(f"SELECT event_type, t, round(v - avg(v) OVER (PARTITION BY event_type) + 1e-8, 6) AS value FROM {_DAILY}")
def anomaly_how_tag(spark, sf_dir):
    cube = daily_events(spark, sf_dir)
    mean, top = (climatology.reduce(cube, how, time_dim="ts", how_label=how) for how in ("mean", "max"))
    both = Cube(mean.df.join(top.df, "event_type"), ("event_type",), ("value_mean", "value_max"))
    return tidy(climatology.anomaly(cube, both, time_dim="ts", climatology_how_tag="mean"))


_UNITS = {"anomaly": ("EUR", "anomaly"), "relative_anomaly": ("%", "relative anomaly"), "rate": ("EUR s^-1", "rate"), "rate of 90 s": ("EUR (1.5 min)^-1", "rate"), "rate of 3 h": ("EUR (3 hours)^-1", "rate"), "rate of 5 days": ("EUR (5 days)^-1", "rate"), "mean": ("EUR", "")}
_STEPS = f"(SELECT event_type, t, v, lag(t) OVER (PARTITION BY event_type ORDER BY t) AS p, lead(t) OVER (PARTITION BY event_type ORDER BY t) AS n FROM {_DAILY})"
_SECONDS = "date_diff('second', coalesce(p, t), CASE WHEN p IS NULL THEN n ELSE t END)"
_TOTALS = {
    "anomaly": f"SELECT event_type, max(v) - avg(v) AS top FROM {_DAILY} GROUP BY ALL",
    "relative_anomaly": f"SELECT event_type, (max(v) - avg(v)) / avg(v) * 100 AS top FROM {_DAILY} GROUP BY ALL",
    "mean": f"SELECT event_type, avg(v) AS top FROM {_DAILY} GROUP BY ALL",
} | {f"rate{n}": f"SELECT event_type, max(v / {_SECONDS}) * {k} AS top FROM {_STEPS} GROUP BY ALL" for n, k in (("", 1), (" of 90 s", 90), (" of 3 h", 10800), (" of 5 days", 432000))}


@query(" UNION ALL ".join(f"SELECT '{n}' AS operator, event_type, round(top + 1e-8, 6) AS top, '{_UNITS[n][0]}' AS units, '{('spend ' + _UNITS[n][1]).strip()}' AS long_name FROM ({sql})" for n, sql in _TOTALS.items()))
def attributes(spark, sf_dir):
    """The largest value that several operators give each type, with the units and name that they give it."""
    cube = daily_events(spark, sf_dir).with_meta("value", units="EUR", long_name="spend", standard_name="spend")
    own = climatology.reduce(cube, "mean", time_dim="ts")
    made = {"anomaly": climatology.anomaly(cube, own, time_dim="ts"), "relative_anomaly": climatology.relative_anomaly(cube, own, time_dim="ts"), "mean": temporal.mean(cube, time_dim="ts")}
    made |= {n: rates.accumulation_to_rate(cube, time_dim="ts", rate_units=u) for n, u in (("rate", "seconds"), ("rate of 90 s", "90 seconds"), ("rate of 3 h", "3 hours"), ("rate of 5 days", "5 days"))}
    rows = []
    for n, c in made.items():
        (v,) = c.vars
        meta = c.df.schema[v].metadata
        rows.append(c.df.groupBy("event_type").agg(F.round(F.max(v) + 1e-8, 6).alias("top")).select(F.lit(n).alias("operator"), "event_type", "top", F.lit(meta.get("units")).alias("units"), F.lit(meta.get("long_name")).alias("long_name")))
    return fold(DataFrame.unionByName, rows)


# Axes
_RARE = f"(SELECT DISTINCT event_type, lat, lon FROM {_GRID} WHERE value > 115)"


@query(
    f"""WITH g AS {_RARE}, y AS (SELECT event_type, lat - lag(lat) OVER (PARTITION BY event_type ORDER BY lat) AS s FROM (SELECT DISTINCT event_type, lat FROM g)), x AS (SELECT event_type, lon - lag(lon) OVER (PARTITION BY event_type ORDER BY lon) AS s FROM (SELECT DISTINCT event_type, lon FROM g))
SELECT event_type, coalesce(any_value(a.ok), true) AND coalesce(any_value(b.ok), true) AS regular FROM g LEFT JOIN (SELECT event_type, max(s) - min(s) <= 1e-5 * max(s) AS ok FROM y GROUP BY ALL) a USING (event_type) LEFT JOIN (SELECT event_type, max(s) - min(s) <= 1e-5 * max(s) AS ok FROM x GROUP BY ALL) b USING (event_type) GROUP BY ALL"""
)
def grid_info(spark, sf_dir):
    """Whether the cells of each type's large values make a regular grid."""
    cube = gridded(spark, sf_dir)
    rare = cube.df.filter("value > 115")
    types = [r[0] for r in rare.select("event_type").distinct().orderBy("event_type").collect()]  # five of them
    found = [(t, spatial_info(Cube(rare.filter(F.col("event_type") == t), ("lat", "lon"), ("value",)))["regular"]) for t in types]
    return spark.createDataFrame(found, "event_type string, regular boolean")


@query(f"SELECT event_type, t, {agg_sql('std', 'value')} FROM (SELECT event_type, user_id % 5 AS m, date_trunc('day', ts)::TIMESTAMP AS t, avg(value) AS value FROM events GROUP BY ALL) GROUP BY ALL")
def ensemble_standard_deviation(spark, sf_dir):
    df = events(spark, sf_dir).df.withColumn("number", F.col("user_id") % 5).drop("user_id")
    members = temporal.daily_mean(Cube.of(df, ("event_type", "number", "event_id", "ts"), ["value"]), time_dim="ts", extra_reduce_dims="event_id")
    return tidy(ensemble.standard_deviation(members))


# Streams. Files are read one by one; rows of the first days come once more with the last, too late to count.
def _in_files(spark: SparkSession, rows: DataFrame, time: str, cut: str) -> str:
    """A folder of three files of rows (time, event_type, value): up to a time, from then on, and late copies of
    rows long past with one row far ahead, which moves the watermark on."""
    path = shared_path(spark, "stream-in")
    at = F.col(time)
    late = rows.filter(at < F.lit("2024-01-03").cast("timestamp")).withColumn("value", F.lit(1e6))
    ahead = rows.limit(1).withColumn(time, F.lit("2030-01-01").cast("timestamp"))
    for part in (rows.filter(at < F.lit(cut).cast("timestamp")), rows.filter(at >= F.lit(cut).cast("timestamp")), late.unionByName(ahead)):
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _out(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """The stream's rows, appended to Parquet in the shared folder."""
    path = shared_path(spark, "stream-out")
    run = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _read_by_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, round(sum(value) + 1e-8, 6) AS value FROM events GROUP BY ALL")
def stream_daily_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are given out when the watermark has passed them; the late rows belong to one of those."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source = _read_by_file(spark, _in_files(spark, rows, "ts", "2024-01-20"), "ts timestamp, event_type string, value double")
    out = _out(resample_stream(source, "D", "sum", time="ts", keys="event_type", values="value", watermark="1 day"), spark)
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("t"), F.round(F.col("value") + 1e-8, 6).alias("value"))


def _hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly_totals(spark, sf_dir).df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return _read_by_file(spark, _in_files(spark, rows, "ts", "2024-01-20"), "ts timestamp, event_type string, value double")


_HOURLY = "(SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL)"


@query(f"SELECT event_type, t, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY t) + 1e-8, 6) AS value FROM {_HOURLY}")
def stream_deaccumulate(spark, sf_dir):
    out = _out(deaccumulate_stream(_hourly_stream(spark, sf_dir), time="ts", keys="event_type", values="value", watermark="1 day"), spark)
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("t"), F.round(F.when(~F.isnan("value"), F.col("value")) + 1e-8, 6).alias("value"))


@query(f"SELECT event_type, t, CASE WHEN count(v) OVER w = 4 THEN round(avg(v) OVER w + 1e-8, 6) END AS value FROM {_HOURLY} WINDOW w AS (PARTITION BY event_type ORDER BY t ROWS 3 PRECEDING)")
def stream_rolling_mean(spark, sf_dir):
    out = _out(rolling_stream(_hourly_stream(spark, sf_dir), 4, "mean", time="ts", keys="event_type", values="value", watermark="1 day"), spark)
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("t"), F.round(F.when(~F.isnan("value"), F.col("value")) + 1e-8, 6).alias("value"))


# Groups of any size
def _weighted_sql(cells: str, keys: str, q: float) -> str:
    """The mean of the step function of the running weight w over a stretch of one effective weight."""
    return f"""WITH c AS (SELECT {keys}, v, sum(w) AS w, sum(w * w) AS w2 FROM ({cells}) WHERE v IS NOT NULL AND w > 0 GROUP BY ALL), a AS (SELECT {keys}, sum(w) AS total, sum(w) ^ 2 / sum(w2) AS n FROM c GROUP BY ALL),
s AS (SELECT {keys}, v, w, total / n AS size, {q} * (n - 1) * total / n AS low, coalesce(sum(w) OVER (PARTITION BY {keys} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c JOIN a USING ({keys}))
SELECT {keys}, round(sum(v * greatest(0, least(low + size, b + w) - greatest(low, b))) / any_value(size) + 1e-8, 6) AS value FROM s GROUP BY ALL"""


_OWN_WEIGHT = "1 + event_id % 7"


def _with_weight(cube: Cube) -> Cube:
    return Cube(cube.df.withColumn("w", (1 + F.col("event_id") % 7).cast("double")), cube.dims, cube.vars, ("w",))


@query(_weighted_sql(f"SELECT event_type, value AS v, ({_OWN_WEIGHT})::DOUBLE AS w FROM events", "event_type", 0.25))
def weighted_quantile_unequal(spark, sf_dir):
    return tidy(core.reduce(_with_weight(by_type(spark, sf_dir)), "quantile", dim=("event_id", "ts"), weights="w", q=0.25))


@query(_weighted_sql(f"SELECT hour(ts)::INTEGER AS hour, value AS v, ({_OWN_WEIGHT})::DOUBLE AS w FROM events", "hour", 0.5))
def climatology_weighted_median(spark, sf_dir):
    cube = _with_weight(by_type(spark, sf_dir))
    return tidy(climatology.reduce(Cube(cube.df, ("ts",), cube.vars, ("w",)), "median", frequency="hour", time_dim="ts", weights="w"))


def _far_std(keys: str, cells: str) -> str:
    return f"WITH c AS ({cells}), m AS (SELECT {keys}, sum(w * v) / sum(w) AS m FROM c GROUP BY ALL) SELECT {keys}, round(sqrt(sum(w * (v - m) ^ 2) / sum(w)), 3) AS value FROM c JOIN m USING ({keys}) GROUP BY ALL"


@query(_far_std("t", f"SELECT date_trunc('day', ts)::TIMESTAMP AS t, 1e9 + value AS v, ({_OWN_WEIGHT})::DOUBLE AS w FROM events"))
def resample_weighted_std(spark, sf_dir):
    """Deviations of values a billion off zero."""
    cube = _with_weight(by_type(spark, sf_dir))
    far = cube.with_df(cube.df.withColumn("value", 1e9 + F.col("value")))
    out = core.resample(far, "D", "std", time_dim="ts", extra_reduce_dims=("event_type", "event_id"), weights="w").df
    return out.select(F.col("ts").alias("t"), F.round("value", 3).alias("value"))


@query(_far_std("region", f"SELECT region, 1e9 + value AS v, {_W} AS w FROM {_GRID} JOIN {_BOXES} ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1") + " UNION ALL SELECT 'none', NULL")
def zonal_weighted_std(spark, sf_dir):
    cube = gridded(spark, sf_dir)
    far = cube.with_df(cube.df.withColumn("value", 1e9 + F.col("value")))
    out = spatial.reduce(far, _regions(spark), "std", mask_dim="region", weights="latitude", extra_reduce_dims=("event_type", "event_id", "ts")).df
    return out.select("region", F.round("value", 3).alias("value"))


@query("SELECT event_type, round(quantile_cont(value, 0.9) + 1e-8, 6) AS value FROM events GROUP BY event_type")
def quantile_of_large_groups(spark, sf_dir):
    return tidy(core.reduce(by_type(spark, sf_dir), "quantile", dim=("event_id", "ts"), q=0.9, large_groups=True))


@query("SELECT month(o_orderdate)::INTEGER AS month, 0.25::DOUBLE AS quantile, round(quantile_cont(o_totalprice, 0.25::DOUBLE) + 1e-8, 6) AS o_totalprice FROM orders GROUP BY ALL UNION ALL SELECT month(o_orderdate)::INTEGER, 0.9::DOUBLE, round(quantile_cont(o_totalprice, 0.9::DOUBLE) + 1e-8, 6) FROM orders GROUP BY ALL")
def climatology_quantiles_of_large_groups(spark, sf_dir):
    cube = Cube(orders(spark, sf_dir).df, ("o_orderdate",), ("o_totalprice",))
    return tidy(climatology.quantiles(cube, [0.25, 0.9], frequency="month", time_dim="o_orderdate", large_groups=True))


class Range(Partial):
    """Largest less smallest value."""

    def init(self):
        return np.inf, -np.inf

    def update(self, state, values):
        return (min(state[0], values.min()), max(state[1], values.max())) if len(values) else state

    def merge(self, a, b):
        return min(a[0], b[0]), max(a[1], b[1])

    def result(self, state):
        return state[1] - state[0] if state[0] <= state[1] else None


@query("SELECT event_type, user_id, round(max(value) - min(value) + 1e-8, 6) AS value FROM events GROUP BY event_type, user_id")
def udf_range_partial(spark, sf_dir):
    return tidy(core.reduce(events(spark, sf_dir), Range(), dim=("event_id", "ts")))


# Long axes and blocks
@query("WITH s AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL) SELECT t, CASE WHEN count(v) OVER w = 24 THEN round(avg(v) OVER w + 1e-8, 6) END AS value FROM s WINDOW w AS (ORDER BY t ROWS 23 PRECEDING)")
def rolling_long_series(spark, sf_dir):
    """A series of time alone."""
    return tidy(core.rolling_reduce(core.reduce(hourly_totals(spark, sf_dir), "sum", dim="event_type"), "mean", ts=24))


for _how in ("prod", "argmin", "argmax"):
    _value = "product(v / 1000) OVER w" if _how == "prod" else f"arg_{_how[3:]}(i, v) OVER w - (i - 2)"
    _value = f"round({_value} + 1e-8, 6)" if _how == "prod" else f"({_value})::DOUBLE"

    @query(f"SELECT event_type, t, CASE WHEN count(v) OVER w = 3 THEN {_value} END AS value FROM {_ONCE} WINDOW w AS (PARTITION BY event_type ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)", f"rolling_{_how}")
    def _(spark, sf_dir, how=_how):
        cube = daily_events(spark, sf_dir)
        cube = cube.with_df(cube.df.withColumn("value", F.col("value") / 1000)) if how == "prod" else cube
        out = tidy(core.rolling_reduce(cube, how, ts=3))
        return out if how == "prod" else out.withColumn("value", F.col("value").cast("double"))


for _how, _sql in (("std", "stddev_pop(b.v)"), ("max", "max(b.v)"), ("count", "count(b.v)")):
    _value = f"round({_sql} + 1e-8, 6)"

    @query(f"""WITH s AS (SELECT (user_id % 10)::BIGINT AS grp, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL),
x AS (SELECT *, dense_rank() OVER (ORDER BY grp) AS gi, dense_rank() OVER (ORDER BY t) AS ti FROM s)
SELECT a.grp, a.t, CASE WHEN count(b.v) >= 3 THEN {_value} END AS value FROM x a JOIN x b ON b.gi BETWEEN a.gi - 2 AND a.gi AND b.ti BETWEEN a.ti - 1 AND a.ti GROUP BY a.grp, a.t""", f"rolling_block_{_how}")
    def _(spark, sf_dir, how=_how):
        cells = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("grp"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "value").groupBy("grp", "ts").agg(F.sum("value").alias("value"))
        out = core.rolling_reduce(Cube.of(cells, ("grp", "ts"), ["value"]), how, dim={"grp": 3, "ts": 2}, min_periods=3)
        return tidy(out.with_df(out.df.withColumn("value", F.col("value").cast("double"))))


# Features line by line, and of very different size
@query(f"SELECT region, event_type, round(avg(value) + 1e-8, 6) AS value FROM (SELECT DISTINCT region, event_type FROM events, {_BOXES}) LEFT JOIN (SELECT region, event_type, value FROM {_GRID} JOIN {_BOXES} ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1) USING (region, event_type) GROUP BY ALL")
def zonal_scanline(spark, sf_dir):
    return tidy(spatial.reduce(gridded(spark, sf_dir), _regions(spark), "mean", mask_dim="region", extra_reduce_dims=("event_id", "ts"), scanline=True))


@query(f"WITH f AS (SELECT 'world' AS name, -180.5 AS x0, -90.5 AS y0, 180.5 AS x1, 90.5 AS y1 UNION ALL SELECT DISTINCT 'user ' || user_id, (user_id % 36) * 10 - 181.0, (user_id % 19) * 10 - 91.0, (user_id % 36) * 10 - 179.0, (user_id % 19) * 10 - 89.0 FROM events) SELECT name, count(*) AS cells FROM f JOIN (SELECT DISTINCT lat, lon FROM {_GRID}) ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY ALL")
def features_of_all_sizes(spark, sf_dir):
    """The whole grid, and a box about the cell of each user."""
    x, y = (F.col("user_id") % 36) * 10.0 - 180, (F.col("user_id") % 19) * 10.0 - 90
    corners = F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().select(F.concat(F.lit("user "), "user_id").alias("name"), F.array(corners).alias("rings"))
    world = spatial.features(spark, [("world", spatial.box(-180.5, -90.5, 180.5, 90.5))], "name")
    return spatial.points_in_features(_daily_grid(spark, sf_dir), users.unionByName(world), "name", "lat", "lon").groupBy("name").agg(F.count("*").alias("cells"))
