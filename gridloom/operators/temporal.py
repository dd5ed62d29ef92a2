"""Statistics along time: whole series, days, months, moving windows, and time labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cube import Cube, names
from ..detect import find_axis, time_axis
from ..functions import statistics as st
from ..functions.periods import datetime_pattern, from_micros, micros, ntz, parse_timedelta
from . import reduce as core

_DAY = 86_400_000_000


def shift_time(cube: Cube, t: str, by) -> Cube:
    """Time labels moved by a span; the column notes it."""
    span = parse_timedelta(by)
    moved = from_micros(micros(F.col(t)) + F.lit(round(span.total_seconds() * 1e6)))
    return cube.with_df(cube.df.withColumn(t, moved.alias(t, metadata={**cube.meta(t), "time_shift": str(span)})))


def trim_ends(cube: Cube, t: str) -> Cube:
    """Without the first and the last time label of the whole cube."""
    ends = cube.df.agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    kept = cube.df.crossJoin(F.broadcast(ends)).filter((F.col(t) > F.col("__lo")) & (F.col(t) < F.col("__hi")))
    return cube.with_df(kept.drop("__lo", "__hi"))


def _prepared(cube: Cube, time_dim, time_shift) -> tuple[Cube, str]:
    t = time_axis(cube, time_dim)
    return (shift_time(cube, t, time_shift) if time_shift else cube), t


def reduce(cube: Cube, how: st.How = "mean", *, frequency: str | None = None, time_dim: str | None = None, dim=None, time_shift=None, remove_partial_periods: bool = False, **options) -> Cube:
    """Over all of time, or over periods if ``frequency`` is given."""
    cube, t = _prepared(cube, time_dim, time_shift)
    if frequency is None:
        out = core.reduce(cube, how, dim=tuple(dict.fromkeys((*names(dim), t))), **options)
        return out
    out = core.resample(cube, frequency, how, time_dim=t, **options)
    return trim_ends(out, t) if time_shift and remove_partial_periods else out


def _periodic(cube: Cube, how, frequency: str, t: str, time_shift, trim: bool, extra, options) -> Cube:
    """Resample along a time dimension, or group by a time coordinate's periods; in the latter case
    the dimension that the coordinate depends on is reduced too."""
    cube, t = _prepared(cube, t, time_shift)
    if t in cube.dims:
        out = core.resample(cube, frequency, how, time_dim=t, extra_reduce_dims=extra, **options)
    else:
        grouped = Cube(cube.df, (*cube.dims, t), cube.vars, (), cube.attrs)
        spanned = [d for d in (find_axis(cube, "t"), *[c for c in ("step", "leadtime", "forecast_period") if c in cube.dims]) if d]
        out = core.resample(grouped, frequency, how, time_dim=t, extra_reduce_dims=(*names(extra), *spanned), **options)
    return trim_ends(out, t) if time_shift and trim else out


def daily_reduce(cube: Cube, how: st.How = "mean", *, time_dim: str | None = None, time_shift=None, remove_partial_periods: bool = False, extra_reduce_dims=None, **options) -> Cube:
    """Daily statistics. A time dimension of spans (a number of microseconds or a day-time interval)
    gives whole days as integers."""
    t = time_axis(cube, time_dim)
    kind = cube.df.schema[t].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        return _periodic(cube, how, "D", t, time_shift, remove_partial_periods, extra_reduce_dims, options)
    span = F.col(t) if kind in ("long", "integer") else F.expr(f"`{t}` div interval '1' day") * _DAY
    days = cube.with_df(cube.df.withColumn(t, F.floor(span / _DAY).cast("long")))
    keep = core.reduce(Cube(days.df.withColumnRenamed(t, "__day").withColumn(t, F.lit(0)), (*days.without(t), "__day", t), days.vars, (), days.attrs), how, dim=(t, *names(extra_reduce_dims)), **options)
    return Cube(keep.df.withColumnRenamed("__day", t), tuple(t if d == "__day" else d for d in keep.dims), keep.vars, (), keep.attrs)


def monthly_reduce(cube: Cube, how: st.How = "mean", *, time_dim: str | None = None, time_shift=None, remove_partial_periods: bool = False, extra_reduce_dims=None, **options) -> Cube:
    """Monthly statistics, labelled by the first of the month."""
    t = time_axis(cube, time_dim)
    kind = cube.df.schema[t].dataType.typeName()
    if not (kind.startswith("timestamp") or kind == "date"):
        raise TypeError(f"months need datetimes, not {kind}")
    return _periodic(cube, how, "MS", t, time_shift, remove_partial_periods, extra_reduce_dims, options)


def _with(operator, how: str, doc: str):
    def wrapped(cube: Cube, **options) -> Cube:
        options.pop("how", None)
        return operator(cube, how, **options)

    wrapped.__doc__ = doc
    wrapped.__name__ = wrapped.__qualname__ = how
    return wrapped


_STATISTICS = ("mean", "median", "min", "max", "std", "sum")
mean, median, min, max, std, sum = (_with(reduce, h, f"The {h} over time.") for h in _STATISTICS)  # noqa: A001
daily_mean, daily_median, daily_min, daily_max, daily_std, daily_sum = (_with(daily_reduce, h, f"Daily {h}.") for h in _STATISTICS)
monthly_mean, monthly_median, monthly_min, monthly_max, monthly_std, monthly_sum = (_with(monthly_reduce, h, f"Monthly {h}.") for h in _STATISTICS)


def rolling_reduce(cube: Cube, window_length: int | None = None, how_reduce: st.How = "mean", *, time_dim: str | None = None, **options) -> Cube:
    """Moving statistics along time."""
    if window_length is None:
        return core.rolling_reduce(cube, how_reduce, **options)
    return core.rolling_reduce(cube, how_reduce, dim={time_axis(cube, time_dim): window_length}, **options)


def standardise_time(cube: Cube, target_format: str = "%Y-%m-%d %H:%M:%S", *, time_dim: str | None = None) -> Cube:
    """Time labels written in a format and read back, which cuts them short or pins parts of them.
    Values stay; labels may become equal."""
    t = time_axis(cube, time_dim)
    kind = cube.df.schema[t].dataType.typeName()
    label = F.col(t) if kind == "string" else F.date_format(t, datetime_pattern(target_format))
    attrs = {**cube.attrs, "history": f"{cube.attrs.get('history', '')}Standardised time dimension {t!r} to {target_format!r}. "}
    return cube.with_df(cube.df.withColumn(t, ntz(label).alias(t, metadata=cube.meta(t))), attrs=attrs)
