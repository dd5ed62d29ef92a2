"""Accumulated values to rates: differences along time over a dense time axis."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cube import Cube, labelled
from ..detect import time_axis
from ..functions.periods import micros, parse_timedelta, span_name
from .reduce import dense_index

TYPES = ("start_of_step", "start_of_forecast", "start_of_day")
# Short names of units of time in the units of rates.
_SHORT = {"seconds": "s", "minutes": "min"}
_PERIODS = ("step", "leadtime", "forecast_period")


def _period_axis(cube: Cube, t: str) -> str | None:
    """The lead-time column, where time counts forecasts."""
    if cube.meta(t).get("standard_name") != "forecast_reference_time" and t != "forecast_reference_time":
        return None
    every = (*cube.dims, *cube.coords)
    by_name = [c for c in every if cube.meta(c).get("standard_name") == "forecast_period"]
    return next((c for c in (*by_name, *_PERIODS) if c in every), None)


def _axis_micros(cube: Cube, axis: str) -> Column:
    kind = cube.df.schema[axis].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        return micros(F.col(axis))
    if kind in ("long", "integer", "short"):
        return F.col(axis).cast("long")
    return (F.extract(F.lit("DAY"), F.col(axis)) * 86_400 + F.extract(F.lit("HOUR"), F.col(axis)) * 3600 + F.extract(F.lit("MINUTE"), F.col(axis)) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(axis)) * 1_000_000).cast("long")


def _rate_units(rate_units) -> tuple[float | None, str]:
    """Seconds of the unit of time (None: the step itself) and the suffix of the units."""
    if rate_units == "step_length":
        return None, ""
    span: timedelta = parse_timedelta(rate_units)
    name = span_name(span)
    for long, short in _SHORT.items():
        name = name.replace(long, short)
    return span.total_seconds(), f" {name}^-1"


def accumulation_to_rate(cube: Cube, *, step=None, rate_units="seconds", time_dim: str | None = None, accumulation_type: str = "start_of_step", from_first_step: bool = False, rate_label: str | None = None, provenance: bool = True) -> Cube:
    """Accumulations as rates per unit of time.

    accumulation_type: values count from the start of each step, of the forecast or of the day.
    Steps are ``step`` or the gaps between time labels. The first label, whose start is unknown,
    goes, unless ``from_first_step`` says that it counts from zero. A cell whose predecessor is
    absent or missing is missing. Integer and interval lead times count in microseconds."""
    if accumulation_type not in TYPES:
        raise ValueError(f"Unknown accumulation_type {accumulation_type!r}; one of {TYPES}")
    t = time_axis(cube, time_dim)
    period = _period_axis(cube, t)
    axis = period or t
    unit, suffix = _rate_units(rate_units)
    labels = dense_index(cube.df, axis)
    first_step = F.min(F.when(F.col("__index") == 1, F.col("__at") - F.col("__before"))).over(Window.partitionBy(F.lit(0)))  # one row per label
    numbered = Cube(labels, (axis,), ("__index", "__previous"))
    labels = labels.select(axis, "__index", "__previous", _axis_micros(numbered, axis).alias("__at"))
    labels = labels.withColumn("__before", F.lag("__at").over(Window.orderBy("__index")))
    if step is not None:
        gap = F.lit(parse_timedelta(step).total_seconds())
    else:
        gap = F.coalesce(F.col("__at") - F.col("__before"), first_step, F.col("__at") if period else F.lit(None)) / 1e6
    labels = labels.select(axis, "__index", "__previous", gap.alias("__gap"))
    if step is None and not period and not labels.filter("__gap is not null").limit(1).count():
        raise ValueError("a step cannot be told from fewer than two time labels; give it")
    others = [d for d in cube.dims if d != axis]
    df = cube.df.join(labels, axis)
    earlier = cube.df.select(*others, F.col(axis).alias("__previous"), *[F.col(v).cast("double").alias(f"__b_{v}") for v in cube.vars])
    if accumulation_type != "start_of_step":
        df = df.join(earlier, [*others, "__previous"], "left")
    scale = F.lit(1.0) if unit is None else F.col("__gap") / unit
    label = {None: "per_step" if unit is None else "rate"}.get(rate_label, rate_label)
    columns = []
    for v in cube.vars:
        value = F.col(v).cast("double")
        if accumulation_type == "start_of_step":
            rate = value
        else:
            rate = F.when(F.col("__index") > 0, value - F.col(f"__b_{v}"))
            first = value
            if accumulation_type == "start_of_day" and not period:
                rate = F.when((F.col("__index") > 0) & (F.hour("__previous") == 0), value).otherwise(rate)
                first = F.when(F.hour(axis) != 0, value)
            if from_first_step:
                rate = F.when(F.col("__index") == 0, first).otherwise(rate)
        meta = {k: x for k, x in {"units": f"{cube.meta(v)['units']}{suffix}" if "units" in cube.meta(v) else None, "long_name": f"{cube.meta(v)['long_name']} {label.replace('_', ' ')}".strip() if "long_name" in cube.meta(v) else None}.items() if x}
        if provenance or "history" in cube.meta(v):
            meta["history"] = "\n".join(x for x in (cube.meta(v).get("history"), f"{accumulation_type} accumulation of {v} as {label or 'value per step'}") if x)
        columns.append((rate / scale).alias(labelled(v, label), metadata=meta))
    keep = accumulation_type == "start_of_step" or from_first_step
    made = df.select(*cube.dims, *cube.coords, "__index", *columns)
    made = made if keep else made.filter("__index > 0")
    return cube.with_df(made.drop("__index"), vars=tuple(labelled(v, label) for v in cube.vars))


def deaccumulate(cube: Cube, *, accumulation_type: str = "start_of_forecast", rate_label: str = "", **options) -> Cube:
    """Accumulations as values per step, under their own names."""
    options.pop("rate_units", None)
    return accumulation_to_rate(cube, rate_units="step_length", accumulation_type=accumulation_type, rate_label=rate_label, **options)
