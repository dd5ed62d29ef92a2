"""Names of statistics to aggregate expressions, plain, weighted and over windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Other names of the statistics.
ALIASES = {
    "average": "mean",
    "nanaverage": "mean",
    "nanmean": "mean",
    "stddev": "std",
    "stdev": "std",
    "nanstd": "std",
    "nanvar": "var",
    "nansum": "sum",
    "nanmax": "max",
    "nanmin": "min",
    "nanmedian": "median",
    "q": "quantile",
    "p": "percentile",
    "product": "prod",
    "nanprod": "prod",
}
#: Functions named by path that propagate missing values, unlike all others.
STRICT = {f"numpy.{n}": n for n in ("mean", "average", "std", "var", "sum", "max", "min", "median", "prod")}
NAN_SAFE = {f"numpy.nan{n}": n for n in ("mean", "std", "var", "sum", "max", "min", "median", "prod")}

How = str | Callable
#: Positions along the dimension, by the statistic that gives the label there.
POSITIONS = {"argmin": "idxmin", "argmax": "idxmax"}
#: Statistics that keep the dimension.
CUMULATIVE = ("cumsum", "cumprod")
WEIGHTED_ONLY = ("sum_of_weights", "sum_of_squares")


def _exact(v: Column, q) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(v.cast("double"), F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, (list, tuple)) else F.lit(float(q)))


#: Options that say nothing about a value here: attributes of columns are always kept.
_IGNORED = ("keep_attrs",)
_LEVELS = ("q", "p", "quantile", "percentile")


def checked_options(name: str | Callable, options: dict) -> tuple[dict, bool]:
    """The options that a statistic takes, and whether it skips missing cells (``skipna``). Any
    other is an error, so that a misspelt one doesn't pass in silence; functions get all others."""
    left = {k: v for k, v in options.items() if k not in _IGNORED}
    skip = bool(left.pop("skipna", True)) if not callable(name) else True
    if not callable(name):
        known = _LEVELS if name in ("quantile", "percentile") else ("ddof",) if name in ("std", "var") else ()
        if unknown := sorted(set(left) - set(known)):
            raise TypeError(f"{name!r} takes no option {unknown}")
    return left, skip


def resolve(how: How) -> str | Callable:
    """Canonical name of a statistic, 'numpy.x' for a strict one, or the callable itself."""
    if callable(how):
        return how
    if how in STRICT:
        return how
    name = NAN_SAFE.get(how, ALIASES.get(how, how))
    name = ALIASES.get(name, name)
    if name not in _PLAIN and name not in ("quantile", "percentile", "idxmin", "idxmax", *POSITIONS, *CUMULATIVE, *WEIGHTED_ONLY):
        raise ValueError(f"unknown statistic {how!r}")
    return name


_PLAIN: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0)),
    "max": F.max,
    "min": F.min,
    "median": lambda v: _exact(v, 0.5),
    "count": F.count,
    "prod": lambda v: F.coalesce(F.product(v), F.lit(1.0)),
    "any": lambda v: F.coalesce(F.bool_or(v != 0), F.lit(False)),
    "all": lambda v: F.coalesce(F.bool_and(v != 0), F.lit(True)),
    "first": None,
    "last": None,
}


def quantile_level(name: str, options: dict) -> float:
    """Level in 0..1 of how='quantile' (q) or 'percentile' (p, or q in 0..100)."""
    if name == "quantile":
        level = options.get("q", options.get("quantile"))
    else:
        level = options.get("p", options.get("percentile", options.get("q")))
        level = level / 100 if level is not None else None
    if level is None or not 0 <= level <= 1:
        raise ValueError(f"{name} needs a level within its range, not {options}")
    return float(level)


def _callable(how: Callable, options: dict) -> Callable[[Column], Column]:
    """A function of (array, axis=...) as a grouped pandas UDF; values come as floats, missing as NaN."""

    def apply(v: pd.Series) -> float:
        return float(how(np.asarray(v, dtype=float), axis=0, **options))

    return lambda v: F.pandas_udf(apply, DoubleType())(v.cast("double"))


def aggregate(how: How, value: Column, *, order: Column | None = None, skip_missing: bool = True, **options) -> Column:
    """The aggregate of a value column. order: for first, last, idxmin and idxmax. ddof: for std
    and var. Missing cells are skipped, unless ``skipna=False`` or the function is a strict one."""
    name = resolve(how)
    strict = name in STRICT if not callable(name) else False
    name = resolve(STRICT[name]) if strict else name
    options, skip = checked_options(name, options)
    if callable(name):
        return _callable(name, options)(value)
    skip_missing = skip_missing and skip and not strict
    if name in WEIGHTED_ONLY:
        raise ValueError(f"{how!r} needs weights")
    if name in ("quantile", "percentile"):
        out = _exact(value, quantile_level(name, options))
    elif name in ("first", "last", "idxmin", "idxmax"):
        if order is None:
            raise ValueError(f"{how!r} needs an ordered dimension")
        # of equal values the first label counts
        out = {
            "first": lambda: F.min_by(value, F.when(value.isNotNull(), order)),
            "last": lambda: F.max_by(value, F.when(value.isNotNull(), order)),
            "idxmin": lambda: F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), order.alias("o"))))["o"],
            "idxmax": lambda: F.min(F.when(value.isNotNull(), F.struct((-value).alias("v"), order.alias("o"))))["o"],
        }[name]()
    elif options.get("ddof") and name in ("std", "var"):
        var = F.var_pop(value) * F.try_divide(F.count(value), F.count(value) - options["ddof"])
        out = F.sqrt(var) if name == "std" else var
    else:
        out = _PLAIN[name](value)
    return out if skip_missing else F.when(F.count(value) == F.count(F.lit(1)), out)


#: Statistics about the weighted mean of their group, which is worked out first for its digits' sake.
ABOUT_MEAN = ("std", "var", "sum_of_squares")


def weighted_name(how: How) -> str:
    """Canonical name of a statistic that takes weights."""
    return resolve(how.__name__ if callable(how) else how.removeprefix("numpy."))


def weighted_mean(value: Column, weight: Column) -> Column:
    v = value.cast("double")
    return F.try_divide(F.sum(weight * v), F.sum(F.when(v.isNotNull(), weight)))


def weighted(how: How, value: Column, weight: Column, centre: Column | None = None, **options) -> Column:
    """Weighted aggregate over the valid cells. centre: the weighted mean of the same cells, which
    statistics about it need. Quantiles are no aggregates: see functions.selection."""
    name = weighted_name(how)
    options, skip = checked_options(name, options)
    if not skip:
        raise TypeError("weighted statistics skip missing cells")
    v = value.cast("double")
    total, product = F.sum(F.when(v.isNotNull(), weight)), F.sum(weight * v)
    if name == "mean":
        return weighted_mean(value, weight)
    if name == "sum":
        return F.coalesce(product, F.lit(0.0))
    if name in ("count", "sum_of_weights"):
        return F.coalesce(total, F.lit(0.0))
    if name in ABOUT_MEAN:
        if centre is None:
            raise ValueError(f"{name!r} needs the weighted mean of its cells")
        squares = F.sum(weight * (v - centre) ** 2)
        if name == "sum_of_squares":
            return F.coalesce(squares, F.lit(0.0))
        var = F.try_divide(squares, total)
        return F.sqrt(var) if name == "std" else var
    raise ValueError(f"no weighted {how!r}")


def latitude_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def of_cells(how: Callable, cells: Column, size: int, options: dict) -> Column:
    """A function of (array, axis=...) of an array of a window's cells, filled up with missing ones at
    its front to the window's size; worked out in batches of windows."""

    def apply(windows: pd.Series) -> pd.Series:
        return pd.Series([float(how(np.asarray(w, dtype=float), axis=0, **options)) for w in windows])

    filled = F.concat(F.array_repeat(F.lit(float("nan")), F.greatest(F.lit(0), F.lit(size) - F.size(cells))), cells)
    out = F.pandas_udf(apply, DoubleType())(filled)
    return F.when(~F.isnan(out), out)


def over_window(how: How, value: Column, window, least: int, size: int, place: Column | None = None, low: int = 0, **options) -> Column:
    """A statistic over a frame of ``size`` labels, missing where it holds fewer than ``least``
    valid values. A function gets the frame's cells, missing ones as NaN. argmin and argmax give
    places in the frame, from 0: place is a row's index, low where its frame begins."""
    name = resolve(how)
    strict = name in STRICT if not callable(name) else False
    name = resolve(STRICT[name]) if strict else name
    options, skip = checked_options(name, options)
    if callable(name):
        out = of_cells(name, F.collect_list(F.coalesce(value.cast("double"), F.lit(float("nan")))).over(window), size, options)
        return F.when(F.count(value).over(window) >= least, out)
    if strict or not skip:
        least = size
    if name in ("median", "quantile", "percentile"):
        out = F.percentile(value.cast("double"), F.lit(0.5 if name == "median" else quantile_level(name, options))).over(window)
    elif name in ("mean", "std", "var", "sum", "max", "min", "count", "prod"):
        out = {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "prod": F.product}[name](value).over(window)
    elif name in POSITIONS and place is not None:
        first = F.min(F.when(value.isNotNull(), F.struct((-value if name == "argmax" else value).alias("v"), place.alias("i")))).over(window)
        out = first["i"] - place - low
    else:
        raise ValueError(f"no rolling {how!r}")
    return F.when(F.count(value).over(window) >= least, out)
