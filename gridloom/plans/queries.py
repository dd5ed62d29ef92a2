"""Queries over the driver's tables, one per operator, and the SQL that gives the same rows.

Floats are rounded to six places on both sides, a little off exact halves, where the order of a
sum would decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..operators import climatology, ensemble, rates, spatial, temporal
from ..operators import reduce as core
from ..operators.spatial import box, features
from ..sources import to_array_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"there is a query {key!r} already")
        QUERIES[key], ORACLE_SQL[key] = f, sql
        return f

    return register


def tidy(cube: Cube) -> DataFrame:
    """The cube's rows with floats rounded and the time label named t."""
    columns: list[Column] = []
    for f in cube.df.schema:
        c = F.col(f.name)
        columns.append((F.round(c + 1e-8, 6) if f.dataType.typeName() in ("double", "float") else c).alias({"ts": "t", "o_orderdate": "t"}.get(f.name, f.name)))
    return cube.df.select(*columns)


def events(spark: SparkSession, sf_dir: str) -> Cube:
    return Cube.of(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "ts", "event_id", "value"), ("event_type", "user_id", "event_id", "ts"), ["value"])


def by_type(spark: SparkSession, sf_dir: str) -> Cube:
    return Cube.of(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "ts", "value"), ("event_type", "event_id", "ts"), ["value"])


def orders(spark: SparkSession, sf_dir: str) -> Cube:
    return Cube.of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice"), ("o_orderkey", "o_orderdate"), ["o_totalprice"])


def daily_orders(spark: SparkSession, sf_dir: str) -> Cube:
    return temporal.daily_reduce(orders(spark, sf_dir), "sum", time_dim="o_orderdate", extra_reduce_dims="o_orderkey")


def daily_events(spark: SparkSession, sf_dir: str) -> Cube:
    return temporal.daily_reduce(by_type(spark, sf_dir), "sum", time_dim="ts", extra_reduce_dims="event_id")


def hourly_totals(spark: SparkSession, sf_dir: str) -> Cube:
    return core.resample(by_type(spark, sf_dir), "h", "sum", time_dim="ts", extra_reduce_dims="event_id")


_SQL = {"mean": "avg(CAST({v} AS DOUBLE))", "std": "stddev_pop({v})", "sum": "sum({v})", "min": "min({v})", "max": "max({v})", "median": "quantile_cont({v}, 0.5)", "var": "var_pop({v})", "count": "count({v})"}


def agg_sql(how: str, v: str, name: str | None = None) -> str:
    inner = _SQL[how].format(v=v)
    return f"{inner if how == 'count' else f'round({inner} + 1e-8, 6)'} AS {name or v}"


# Reductions over dimensions
for _how in ("mean", "std", "sum", "min", "max", "median", "var", "count"):

    @query(f"SELECT event_type, {agg_sql(_how, 'value')} FROM events GROUP BY event_type", f"temporal_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(temporal.reduce(by_type(spark, sf_dir), how, time_dim="ts", dim="event_id"))


@query("SELECT round(avg(value) + 1e-8, 6) AS value_all FROM events")
def reduce_all(spark, sf_dir):
    return tidy(core.reduce(by_type(spark, sf_dir), "mean", how_label="all"))


@query("SELECT event_type, round(quantile_cont(value, 0.9) + 1e-8, 6) AS value_q90 FROM events GROUP BY event_type")
def reduce_quantile(spark, sf_dir):
    return tidy(core.reduce(by_type(spark, sf_dir), "percentile", dim=("event_id", "ts"), p=90, how_label="q90"))


@query("SELECT event_type, round(arg_min(value, ts) + 1e-8, 6) AS value_first FROM (SELECT event_type, ts, avg(value) AS value FROM events GROUP BY ALL) GROUP BY event_type")
def reduce_first(spark, sf_dir):
    cells = core.reduce(by_type(spark, sf_dir), "mean", dim="event_id")
    return tidy(core.reduce(cells, "first", dim="ts", how_label="first"))


@query("SELECT event_type, user_id, round(max(value) - min(value) + 1e-8, 6) AS value FROM events GROUP BY event_type, user_id")
def udf_range(spark, sf_dir):
    def spread(x, axis=None):
        return x.max(axis=axis) - x.min(axis=axis)

    return tidy(core.reduce(events(spark, sf_dir), spread, dim=("event_id", "ts")))


# Daily statistics, resampling
for _how in ("mean", "min", "max", "std", "sum", "median"):

    @query(f"SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, {agg_sql(_how, 'value')} FROM events GROUP BY ALL", f"daily_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(getattr(temporal, f"daily_{how}")(by_type(spark, sf_dir), time_dim="ts", extra_reduce_dims="event_id"))

    @query(f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS t, {agg_sql(_how, 'o_totalprice')} FROM orders GROUP BY ALL", f"monthly_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(getattr(temporal, f"monthly_{how}")(orders(spark, sf_dir), time_dim="o_orderdate", extra_reduce_dims="o_orderkey"))


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts + INTERVAL 12 HOUR)::TIMESTAMP AS t, avg(value) AS value FROM events GROUP BY ALL)
SELECT event_type, t, round(value + 1e-8, 6) AS value FROM d WHERE t > (SELECT min(t) FROM d) AND t < (SELECT max(t) FROM d)""")
def daily_mean_shifted(spark, sf_dir):
    return tidy(temporal.daily_mean(by_type(spark, sf_dir), time_dim="ts", extra_reduce_dims="event_id", time_shift={"hours": 12}, remove_partial_periods=True))


_BUCKETS = {
    "resample_5d": ("events", "5D", "time_bucket(INTERVAL 5 DAY, ts, (SELECT date_trunc('day', min(ts))::TIMESTAMP FROM events))"),
    "resample_6h": ("events", "6h", "time_bucket(INTERVAL 6 HOUR, ts, (SELECT date_trunc('day', min(ts))::TIMESTAMP FROM events))"),
    "resample_hour": ("events", "hour", "date_trunc('hour', ts)::TIMESTAMP"),
    "resample_week": ("orders", "W", "date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 6 DAY"),
    "resample_month_end": ("orders", "ME", "last_day(o_orderdate)::TIMESTAMP"),
    "resample_year_end": ("orders", "YE", "make_timestamp(year(o_orderdate), 12, 31, 0, 0, 0)"),
    "resample_quarter": ("orders", "QS", "date_trunc('quarter', o_orderdate)::TIMESTAMP"),
    "resample_quarter_end": ("orders", "QE", "last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::TIMESTAMP"),
    "resample_3ms": ("orders", "3MS", "(SELECT date_trunc('month', min(o_orderdate)) FROM orders)::TIMESTAMP + to_months(CAST(3 * floor(datediff('month', (SELECT min(o_orderdate) FROM orders), o_orderdate) / 3) AS INTEGER))"),
    "resample_2me": ("orders", "2ME", "last_day((SELECT date_trunc('month', min(o_orderdate)) FROM orders) + to_months(CAST(2 * ceil(datediff('month', (SELECT min(o_orderdate) FROM orders), o_orderdate) / 2.0) AS INTEGER)))::TIMESTAMP"),
    "resample_2w": ("orders", "2W", "(SELECT date_trunc('week', min(o_orderdate)) FROM orders)::TIMESTAMP + INTERVAL 6 DAY + to_days(CAST(14 * ceil(datediff('day', (SELECT date_trunc('week', min(o_orderdate)) FROM orders), date_trunc('week', o_orderdate)) / 14.0) AS INTEGER))"),
}
for _name, (_table, _freq, _label) in _BUCKETS.items():
    _v, _key = ("value", "event_id") if _table == "events" else ("o_totalprice", "o_orderkey")
    _types = "event_type, " if _table == "events" else ""

    @query(f"SELECT {_types}{_label} AS t, {agg_sql('mean', _v)} FROM {_table} GROUP BY ALL", _name)
    def _(spark, sf_dir, table=_table, freq=_freq, key=_key):
        cube, t = (by_type(spark, sf_dir), "ts") if table == "events" else (orders(spark, sf_dir), "o_orderdate")
        return tidy(temporal.reduce(cube, "mean", frequency=freq, time_dim=t, extra_reduce_dims=key))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS t, avg(value) AS value FROM events GROUP BY ALL),
g AS (SELECT e.event_type, unnest(generate_series((SELECT min(t) FROM h), (SELECT max(t) FROM h), INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT event_type FROM h) e)
SELECT event_type, t, round(value + 1e-8, 6) AS value FROM g LEFT JOIN h USING (event_type, t)""")
def resample_filled(spark, sf_dir):
    return tidy(core.resample(by_type(spark, sf_dir), "h", "mean", time_dim="ts", extra_reduce_dims="event_id", fill_gaps=True))


@query("SELECT strftime(o_orderdate, '%Y-%m-15')::TIMESTAMP AS t, o_orderkey, round(o_totalprice + 1e-8, 6) AS o_totalprice FROM orders")
def standardise_time_15(spark, sf_dir):
    return tidy(temporal.standardise_time(orders(spark, sf_dir), "%Y-%m-15", time_dim="o_orderdate"))


# Climatologies
_COMPONENTS = {"month": "month(o_orderdate)", "dayofyear": "dayofyear(o_orderdate)", "weekofyear": "weekofyear(o_orderdate)", "quarter": "quarter(o_orderdate)", "year": "year(o_orderdate)", "dayofweek": "isodow(o_orderdate) - 1"}
for _c, _expr in _COMPONENTS.items():

    @query(f"SELECT ({_expr})::INTEGER AS {_c}, {agg_sql('mean', 'o_totalprice')} FROM orders GROUP BY ALL", f"climatology_{_c}")
    def _(spark, sf_dir, name=_c):
        cube = orders(spark, sf_dir)
        return tidy(_without_keys(climatology.reduce(_one_series(cube), "mean", frequency=name, time_dim="o_orderdate")))


def _one_series(cube: Cube) -> Cube:
    """All orders as one series of time labels, which may repeat."""
    return Cube(cube.df, ("o_orderdate",), cube.vars, (), cube.attrs)


def _without_keys(cube: Cube) -> Cube:
    return cube.with_df(cube.df.drop("season_order"))


for _how in ("median", "min", "max", "std"):

    @query(f"SELECT month(o_orderdate)::INTEGER AS month, {agg_sql(_how, 'o_totalprice')} FROM orders GROUP BY ALL", f"climatology_monthly_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(getattr(climatology, f"monthly_{how}")(_one_series(orders(spark, sf_dir)), time_dim="o_orderdate"))

    @query(f"SELECT dayofyear(o_orderdate)::INTEGER AS dayofyear, {agg_sql(_how, 'o_totalprice')} FROM orders GROUP BY ALL", f"climatology_daily_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(getattr(climatology, f"daily_{how}")(_one_series(orders(spark, sf_dir)), time_dim="o_orderdate"))


@query("SELECT year(o_orderdate)::INTEGER AS year, round(quantile_cont(o_totalprice, 0.5) + 1e-8, 6) AS o_totalprice FROM orders GROUP BY ALL")
def climatology_median_default(spark, sf_dir):
    return tidy(climatology.median(_one_series(orders(spark, sf_dir)), time_dim="o_orderdate"))


@query("""SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) < 6 THEN 'MAM' WHEN month(o_orderdate) < 9 THEN 'JJA' ELSE 'SON' END AS season,
CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1 WHEN month(o_orderdate) < 6 THEN 2 WHEN month(o_orderdate) < 9 THEN 3 ELSE 4 END::BIGINT AS season_order, round(avg(o_totalprice) + 1e-8, 6) AS o_totalprice FROM orders GROUP BY ALL""")
def climatology_season(spark, sf_dir):
    return tidy(climatology.mean(_one_series(orders(spark, sf_dir)), frequency="season", time_dim="o_orderdate"))


@query("SELECT event_type, hour(ts)::INTEGER AS hour, round(avg(value) + 1e-8, 6) AS value FROM events GROUP BY ALL")
def climatology_hour(spark, sf_dir):
    cube = by_type(spark, sf_dir)
    return tidy(climatology.reduce(Cube(cube.df, ("event_type", "ts"), cube.vars), "mean", frequency="hour", time_dim="ts"))


@query("SELECT month(o_orderdate)::INTEGER AS month, round(avg(o_totalprice) + 1e-8, 6) AS o_totalprice FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01' GROUP BY ALL")
def climatology_range(spark, sf_dir):
    return tidy(climatology.monthly_mean(_one_series(orders(spark, sf_dir)), time_dim="o_orderdate", climatology_range=("1996", "1998")))


@query("SELECT month(o_orderdate)::INTEGER AS month, 0.25::DOUBLE AS quantile, round(quantile_cont(o_totalprice, 0.25::DOUBLE) + 1e-8, 6) AS o_totalprice FROM orders GROUP BY ALL UNION ALL SELECT month(o_orderdate)::INTEGER, 0.9::DOUBLE, round(quantile_cont(o_totalprice, 0.9::DOUBLE) + 1e-8, 6) FROM orders GROUP BY ALL")
def climatology_quantiles(spark, sf_dir):
    return tidy(climatology.quantiles(_one_series(orders(spark, sf_dir)), [0.25, 0.9], frequency="month", time_dim="o_orderdate"))


@query("SELECT year(o_orderdate)::INTEGER AS year, 75::DOUBLE AS percentile, round(quantile_cont(o_totalprice, 0.75::DOUBLE) + 1e-8, 6) AS o_totalprice FROM orders GROUP BY ALL")
def climatology_percentiles(spark, sf_dir):
    return tidy(climatology.percentiles(_one_series(orders(spark, sf_dir)), 75, time_dim="o_orderdate"))


@query("SELECT (3 * ceil(month(o_orderdate) / 3.0))::DOUBLE AS month_bins, round(avg(o_totalprice) + 1e-8, 6) AS o_totalprice FROM orders GROUP BY ALL")
def climatology_bins_month(spark, sf_dir):
    return tidy(climatology.reduce(_one_series(orders(spark, sf_dir)), "mean", frequency="3MS", time_dim="o_orderdate"))


@query("SELECT (50 * ceil(dayofyear(o_orderdate) / 50.0))::DOUBLE AS dayofyear_bins, round(avg(o_totalprice) + 1e-8, 6) AS o_totalprice FROM orders WHERE dayofyear(o_orderdate) <= 350 GROUP BY ALL")
def climatology_bins_dayofyear(spark, sf_dir):
    return tidy(climatology.reduce(_one_series(orders(spark, sf_dir)), "mean", frequency="dayofyear", bin_widths=50, time_dim="o_orderdate"))


# Anomalies of daily totals
_DAYS = "WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL), c AS (SELECT month(t) AS m, avg(v) AS c FROM d GROUP BY ALL) "


@query(_DAYS + "SELECT t, round(v - c + 1e-8, 6) AS o_totalprice FROM d JOIN c ON month(t) = m")
def anomaly_monthly(spark, sf_dir):
    cube = daily_orders(spark, sf_dir)
    return tidy(climatology.anomaly(cube, climatology.monthly_mean(cube, time_dim="o_orderdate"), time_dim="o_orderdate"))


@query(_DAYS + "SELECT t, round((v - c) / c * 100 + 1e-8, 6) AS o_totalprice FROM d JOIN c ON month(t) = m")
def anomaly_relative(spark, sf_dir):
    cube = daily_orders(spark, sf_dir)
    return tidy(climatology.relative_anomaly(cube, climatology.monthly_mean(cube, time_dim="o_orderdate"), time_dim="o_orderdate"))


@query(_DAYS + "SELECT t, round(v - (SELECT avg(v) FROM d) + 1e-8, 6) AS o_totalprice FROM d")
def anomaly_scalar(spark, sf_dir):
    cube = daily_orders(spark, sf_dir)
    return tidy(climatology.anomaly(cube, climatology.mean(cube, time_dim="o_orderdate"), time_dim="o_orderdate"))


@query(_DAYS + "SELECT make_timestamp(year(t), 12, 31, 0, 0, 0) AS t, round(avg(v) - (SELECT avg(v) FROM d) + 1e-8, 6) AS o_totalprice FROM d GROUP BY ALL")
def anomaly_year(spark, sf_dir):
    cube = daily_orders(spark, sf_dir)
    return tidy(climatology.anomaly(cube, climatology.mean(cube, time_dim="o_orderdate"), frequency="year", time_dim="o_orderdate"))


@query("WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL), c AS (SELECT month(t) AS m, avg(v) AS c FROM d WHERE year(t) < 1999 GROUP BY ALL) SELECT date_trunc('month', t)::TIMESTAMP AS t, round(avg(v - c) + 1e-8, 6) AS o_totalprice FROM d JOIN c ON month(t) = m GROUP BY ALL")
def anomaly_auto(spark, sf_dir):
    return tidy(climatology.auto_anomaly(daily_orders(spark, sf_dir), climatology_frequency="month", climatology_range=("1990", "1998"), frequency="month", time_dim="o_orderdate"))


# Rolling windows over daily totals of each type
_SERIES = """WITH s AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL),
g AS (SELECT e.event_type, d.t, s.v, dense_rank() OVER (ORDER BY d.t) AS i FROM (SELECT DISTINCT event_type FROM s) e CROSS JOIN (SELECT DISTINCT t FROM s) d LEFT JOIN s ON s.event_type = e.event_type AND s.t = d.t) """


def _rolling_sql(expr: str, frame: str, least: int) -> str:
    over = f"OVER (PARTITION BY event_type ORDER BY i {frame})"
    return _SERIES + f"SELECT event_type, t, value FROM (SELECT event_type, t, v, CASE WHEN count(v) {over} >= {least} THEN round({expr} {over} + 1e-8, 6) END AS value FROM g) WHERE v IS NOT NULL"


@query(_rolling_sql("avg(v)", "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", 3))
def rolling_mean(spark, sf_dir):
    return tidy(temporal.rolling_reduce(daily_events(spark, sf_dir), 3, "mean", time_dim="ts"))


@query(_rolling_sql("stddev_pop(v)", "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING", 4))
def rolling_std_centred(spark, sf_dir):
    return tidy(temporal.rolling_reduce(daily_events(spark, sf_dir), 4, "std", time_dim="ts", center=True))


@query(_rolling_sql("sum(v)", "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", 2))
def rolling_sum_min_periods(spark, sf_dir):
    return tidy(temporal.rolling_reduce(daily_events(spark, sf_dir), 7, "sum", time_dim="ts", min_periods=2))


@query(_rolling_sql("quantile_cont(v, 0.5)", "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", 3))
def rolling_median(spark, sf_dir):
    return tidy(temporal.rolling_reduce(daily_events(spark, sf_dir), 3, "median", time_dim="ts"))


@query("""WITH s AS (SELECT (user_id % 10)::BIGINT AS grp, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL),
x AS (SELECT *, dense_rank() OVER (ORDER BY grp) AS gi, dense_rank() OVER (ORDER BY t) AS ti FROM s)
SELECT a.grp, a.t, CASE WHEN count(b.v) >= 4 THEN round(avg(b.v) + 1e-8, 6) END AS value FROM x a JOIN x b ON b.gi BETWEEN a.gi - 1 AND a.gi AND b.ti BETWEEN a.ti - 1 AND a.ti GROUP BY a.grp, a.t""")
def rolling_2d(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("grp"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "value").groupBy("grp", "ts").agg(F.sum("value").alias("value"))
    return tidy(core.rolling_reduce(Cube.of(cells, ("grp", "ts"), ["value"]), "mean", dim={"grp": 2, "ts": 2}))


# Rates of hourly totals
_HOURS = """WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL),
a AS (SELECT t, lag(t) OVER (ORDER BY t) AS p, lead(t) OVER (ORDER BY t) AS n, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM h)),
x AS (SELECT h.event_type, h.t, h.v, a.p, a.i, CASE WHEN lag(h.t) OVER w = a.p THEN lag(h.v) OVER w END AS b, date_diff('second', coalesce(a.p, h.t), CASE WHEN a.p IS NULL THEN a.n ELSE h.t END) AS s FROM h JOIN a USING (t) WINDOW w AS (PARTITION BY event_type ORDER BY h.t)) """


@query(_HOURS + "SELECT event_type, t, round(v / s + 1e-8, 6) AS value_rate FROM x")
def rate_start_of_step(spark, sf_dir):
    return tidy(rates.accumulation_to_rate(hourly_totals(spark, sf_dir), time_dim="ts"))


@query(_HOURS + "SELECT event_type, t, round((v - b) / (s / 3600) + 1e-8, 6) AS value_rate FROM x WHERE i > 1")
def rate_start_of_forecast(spark, sf_dir):
    return tidy(rates.accumulation_to_rate(hourly_totals(spark, sf_dir), time_dim="ts", accumulation_type="start_of_forecast", rate_units="hours"))


@query(_HOURS + "SELECT event_type, t, round(CASE WHEN i = 1 THEN CASE WHEN hour(t) <> 0 THEN v END WHEN hour(p) = 0 THEN v ELSE v - b END / s + 1e-8, 6) AS value_rate FROM x")
def rate_start_of_day(spark, sf_dir):
    return tidy(rates.accumulation_to_rate(hourly_totals(spark, sf_dir), time_dim="ts", accumulation_type="start_of_day", from_first_step=True))


@query(_HOURS + "SELECT event_type, t, round(CASE WHEN i = 1 THEN v ELSE v - b END + 1e-8, 6) AS value FROM x")
def deaccumulate(spark, sf_dir):
    return tidy(rates.deaccumulate(hourly_totals(spark, sf_dir), time_dim="ts", from_first_step=True))


# Weights, features, masks: a grid derived from the users
_GRID = "(SELECT event_type, event_id, ts, value, ((user_id % 19) * 10 - 90)::DOUBLE AS lat, ((user_id % 36) * 10 - 180)::DOUBLE AS lon FROM events)"
_W = "greatest(cos(radians(lat)), -1.0)"


def gridded(spark: SparkSession, sf_dir: str) -> Cube:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "ts", "value", ((F.col("user_id") % 19) * 10 - 90).cast("double").alias("lat"), ((F.col("user_id") % 36) * 10 - 180).cast("double").alias("lon"))
    return Cube.of(df, ("event_type", "event_id", "ts", "lat", "lon"), ["value"])


@query(f"SELECT event_type, round(sum({_W} * value) / sum({_W}) + 1e-8, 6) AS value FROM {_GRID} GROUP BY ALL")
def weighted_mean(spark, sf_dir):
    return tidy(core.reduce(gridded(spark, sf_dir), "mean", dim=("event_id", "ts", "lat", "lon"), weights="latitude"))


@query(f"SELECT event_type, round(sum({_W} * value) + 1e-8, 6) AS value FROM {_GRID} GROUP BY ALL")
def weighted_sum(spark, sf_dir):
    return tidy(core.reduce(gridded(spark, sf_dir), "sum", dim=("event_id", "ts", "lat", "lon"), weights="latitude"))


@query(f"WITH g AS {_GRID}, m AS (SELECT event_type, sum({_W} * value) / sum({_W}) AS m FROM g GROUP BY ALL) SELECT event_type, round(sqrt(sum({_W} * (value - m) ^ 2) / sum({_W})) + 1e-8, 6) AS value FROM g JOIN m USING (event_type) GROUP BY ALL")
def weighted_std(spark, sf_dir):
    return tidy(core.reduce(gridded(spark, sf_dir), "std", dim=("event_id", "ts", "lat", "lon"), weights="latitude"))


@query(f"SELECT event_type, round(sum((lat + 91) * value) / sum(lat + 91) + 1e-8, 6) AS value FROM {_GRID} GROUP BY ALL")
def weighted_by_table(spark, sf_dir):
    cube = gridded(spark, sf_dir)
    table = cube.df.select("lat").distinct().withColumn("w", F.col("lat") + 91)
    return tidy(core.reduce(cube, "mean", dim=("event_id", "ts", "lat", "lon"), weights=table))


def _regions(spark: SparkSession) -> DataFrame:
    return features(spark, [("north", box(-95, 5, 95, 65)), ("south", box(-185, -85, 55, -15)), ("none", box(171, 71, 174, 74))], "region")


_BOXES = "(VALUES ('north', -95, 5, 95, 65), ('south', -185, -85, 55, -15), ('none', 171, 71, 174, 74)) AS r(region, x0, y0, x1, y1)"
for _how in ("mean", "sum", "min", "max", "std", "count"):
    _zero = {"sum": "0.0", "count": "0"}.get(_how)
    _value = agg_sql(_how, "value").removesuffix(" AS value")

    @query(f"SELECT region, event_type, {f'coalesce({_value}, {_zero})' if _zero else _value} AS value FROM {_BOXES} CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN {_GRID} g USING (event_type) GROUP BY ALL".replace("LEFT JOIN " + _GRID + " g USING (event_type)", f"LEFT JOIN {_GRID} g ON g.event_type = e.event_type AND lon > x0 AND lon < x1 AND lat > y0 AND lat < y1").replace("SELECT region, event_type,", "SELECT region, e.event_type,"), f"zonal_{_how}")
    def _(spark, sf_dir, how=_how):
        return tidy(spatial.reduce(gridded(spark, sf_dir), _regions(spark), how, mask_dim="region", extra_reduce_dims=("event_id", "ts")))


@query(f"SELECT region, event_type, round(sum({_W} * value) / sum({_W}) + 1e-8, 6) AS value FROM {_GRID} JOIN {_BOXES} ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY ALL UNION ALL SELECT DISTINCT 'none', event_type, NULL FROM events")
def zonal_weighted(spark, sf_dir):
    return tidy(spatial.reduce(gridded(spark, sf_dir), _regions(spark), "mean", mask_dim="region", weights="latitude", extra_reduce_dims=("event_id", "ts")))


def _daily_grid(spark: SparkSession, sf_dir: str) -> Cube:
    return core.reduce(gridded(spark, sf_dir), "sum", dim=("event_type", "event_id", "ts"))


@query(f"SELECT lat, lon, region, CASE WHEN lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 THEN value END AS value FROM (SELECT lat, lon, round(sum(value) + 1e-8, 6) AS value FROM {_GRID} GROUP BY ALL) CROSS JOIN {_BOXES}")
def mask_cells(spark, sf_dir):
    return tidy(spatial.mask(_daily_grid(spark, sf_dir), _regions(spark), mask_dim="region"))


@query(f"SELECT lat, lon, CASE WHEN (lon > -95 AND lon < 95 AND lat > 5 AND lat < 65) OR (lon > -185 AND lon < 55 AND lat > -85 AND lat < -15) THEN value END AS value FROM (SELECT lat, lon, round(sum(value) + 1e-8, 6) AS value FROM {_GRID} GROUP BY ALL)")
def mask_union(spark, sf_dir):
    return tidy(spatial.mask(_daily_grid(spark, sf_dir), _regions(spark), union_geometries=True))


@query(f"SELECT k.index, round(avg(value) + 1e-8, 6) AS value FROM (SELECT lat, lon, sum(value) AS value FROM {_GRID} GROUP BY ALL) JOIN (VALUES (0::BIGINT, 0), (1::BIGINT, 40)) k(index, least) ON lat > least GROUP BY ALL")
def mask_precomputed(spark, sf_dir):
    cube = _daily_grid(spark, sf_dir)
    masks = [cube.df.select("lat", "lon", F.when(F.col("lat") > least, 1.0).otherwise(0.0).alias("mask")) for least in (0, 40)]
    return tidy(spatial.reduce(cube, how="mean", mask_arrays=masks))


@query(f"SELECT lat, lon, region, CASE WHEN lon >= x0 - 5 AND lon <= x1 + 5 AND lat >= y0 - 5 AND lat <= y1 + 5 THEN 1 ELSE 0 END AS mask FROM (SELECT DISTINCT lat, lon FROM {_GRID}) CROSS JOIN {_BOXES}")
def mask_all_touched(spark, sf_dir):
    return tidy(spatial.masks_of(_daily_grid(spark, sf_dir), _regions(spark), mask_dim="region", all_touched=True))


# Ensembles: five members
for _how in ("mean", "std", "min", "max", "sum"):

    @query(f"SELECT event_type, t, {agg_sql(_how, 'value')} FROM (SELECT event_type, user_id % 5 AS m, date_trunc('day', ts)::TIMESTAMP AS t, avg(value) AS value FROM events GROUP BY ALL) GROUP BY ALL", f"ensemble_{_how}")
    def _(spark, sf_dir, how=_how):
        df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 5).alias("number"), "event_id", "ts", "value")
        members = temporal.daily_mean(Cube.of(df, ("event_type", "number", "event_id", "ts"), ["value"]), time_dim="ts", extra_reduce_dims="event_id")
        return tidy(getattr(ensemble, how)(members))


# Outputs
@query("SELECT event_type, string_agg(CAST(round(v * 100) AS BIGINT)::VARCHAR, ',' ORDER BY t) AS cents FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL) GROUP BY ALL")
def compact_array(spark, sf_dir):
    rows = to_array_rows(daily_events(spark, sf_dir), "ts")
    return rows.select("event_type", F.array_join(F.transform("value", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("cents"))


@query("WITH s AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL), a AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM s)) SELECT event_type, round(regr_slope(v, i) + 1e-8, 6) AS value FROM s JOIN a USING (t) GROUP BY ALL")
def ols_slope(spark, sf_dir):
    cube = daily_events(spark, sf_dir)
    indexed = cube.df.join(core.dense_index(cube.df, "ts"), "ts")
    return indexed.groupBy("event_type").agg(F.round(F.regr_slope("value", F.col("__index").cast("double")) + 1e-8, 6).alias("value"))
