"""Climatologies: statistics by datetime component, quantiles, and anomalies from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cube import Cube, aggregated, labelled, names
from ..detect import infer_frequency, time_axis
from ..functions import statistics as st
from ..functions.periods import bins, component, parse_component, season_order, time_range
from . import reduce as core
from . import temporal

#: Components that tell how a climatology is to be matched, in order of priority.
CLIMATOLOGY_DIMS = ("dayofyear", "week", "weekofyear", "month", "season", "hour")


def _grouped(cube: Cube, t: str, frequency: str | None, bin_widths) -> tuple[Cube, str]:
    """The cube with its component (or bin of it) as a dimension in place of time."""
    frequency = frequency or infer_frequency(cube, t)
    name, width = parse_component(frequency)
    if name == "day":
        raise ValueError("a climatology has no frequency 'day'; use 'dayofyear'")
    widths = bin_widths if bin_widths is not None else width
    name, value = component(name, F.col(t))
    if widths is not None:
        name, value = f"{name}_bins", bins(name, value, widths)
    df = cube.df.withColumn(name, value)
    if widths is not None:
        df = df.filter(F.col(name).isNotNull())
    return Cube(df, (*cube.without(t), name), cube.vars, (t,), cube.attrs), name


def _ranged(cube: Cube, t: str, climatology_range) -> Cube:
    if climatology_range is None:
        return cube
    if len(climatology_range) != 2:
        raise ValueError("climatology_range is a pair of start and end")
    keep = time_range(F.col(t), *climatology_range)
    return cube if keep is None else cube.with_df(cube.df.filter(keep))


def reduce(cube: Cube, how: st.How = "mean", *, frequency: str | None = None, bin_widths=None, time_dim: str | None = None, climatology_range=None, weights=None, lat: str | None = None, how_label: str | None = None, groupby_kwargs: dict | None = None, **options) -> Cube:
    """A statistic over all years for each value of a component; over the whole period if no
    frequency is given. A season's groups carry ``season_order`` beside them."""
    given = groupby_kwargs or {}
    frequency, bin_widths = given.get("frequency", frequency), given.get("bin_widths", bin_widths)
    t = time_axis(cube, time_dim)
    cube = _ranged(cube, t, climatology_range)
    if frequency is None and bin_widths is None:
        return core.reduce(cube, how, dim=t, weights=weights, lat=lat, how_label=how_label, **options)
    grouped, name = _grouped(cube, t, frequency, bin_widths)
    out = {v: labelled(v, how_label) for v in cube.vars}
    result = core.grouped(grouped, grouped.dims, how, out, order=F.col(t), weights=weights, lat=lat, **options)
    return result.with_df(result.df.withColumn("season_order", season_order(F.col("season"))), coords=("season_order",)) if name == "season" else result


def quantiles(cube: Cube, q, *, frequency: str = "year", bin_widths=None, time_dim: str | None = None, climatology_range=None, label: str = "quantile", labels=None, large_groups: bool = False) -> Cube:
    """Exact quantiles by component (by year unless said otherwise), all in one pass, along a new
    dimension. q: a level in 0..1 or several. ``large_groups``: see reduce.grouped."""
    levels = [float(x) for x in (q if isinstance(q, (list, tuple)) else [q])]
    if any(not 0 <= x <= 1 for x in levels):
        raise ValueError(f"quantiles lie in 0..1: {levels}")
    t = time_axis(cube, time_dim)
    grouped, _ = _grouped(_ranged(cube, t, climatology_range), t, frequency, bin_widths)
    if large_groups:
        found = core.selected(grouped, grouped.dims, {v: v for v in cube.vars}, [*levels, levels[-1]], None)  # an array, also of one level
    else:
        exprs = {v: F.percentile(F.col(v).cast("double"), F.array(*map(F.lit, levels))) for v in cube.vars}
        found = aggregated(grouped, list(grouped.dims), grouped.dims, exprs, {})
    each = F.arrays_zip(F.array(*[F.lit(float(x)) for x in (labels or levels)]).alias("__l"), *[F.slice(F.coalesce(v, F.array(*[F.lit(None).cast("double")] * len(levels))), 1, len(levels)).alias(v) for v in cube.vars])
    rows = found.df.select(*grouped.dims, F.explode(each).alias("__x")).select(*grouped.dims, F.col("__x.__l").alias(label), *[F.col(f"__x.{v}").alias(v, metadata=cube.meta(v)) for v in cube.vars])
    return Cube(rows, (*grouped.dims, label), cube.vars, (), cube.attrs)


def percentiles(cube: Cube, p, **options) -> Cube:
    """Quantiles by percentages, kept as labels."""
    given = p if isinstance(p, (list, tuple)) else [p]
    return quantiles(cube, [x / 100 for x in given], label="percentile", labels=given, **options)


def median(cube: Cube, *, frequency: str = "year", how_label: str | None = None, **options) -> Cube:
    """The median by component; unlike the other statistics by year unless said otherwise."""
    return reduce(cube, "median", frequency=frequency, how_label=how_label, **options)


mean, min, max, std = (temporal._with(reduce, h, f"Climatological {h}.") for h in ("mean", "min", "max", "std"))  # noqa: A001


def daily_reduce(cube: Cube, how: st.How = "mean", **options) -> Cube:
    """By day of the year."""
    return reduce(cube, how, frequency="dayofyear", **options)


def monthly_reduce(cube: Cube, how: st.How = "mean", **options) -> Cube:
    """By month of the year."""
    return reduce(cube, how, frequency="month", **options)


_STATISTICS = ("mean", "median", "min", "max", "std")
daily_mean, daily_median, daily_min, daily_max, daily_std = (temporal._with(daily_reduce, h, f"{h} by day of the year.") for h in _STATISTICS)
monthly_mean, monthly_median, monthly_min, monthly_max, monthly_std = (temporal._with(monthly_reduce, h, f"{h} by month.") for h in _STATISTICS)


def _matched(v: str, climatology: Cube, tag: str) -> str:
    """The climatology's variable for v: of its name, the only one that contains it, or v_tag of several."""
    like = [v] if v in climatology.vars else [c for c in climatology.vars if v in c]
    if len(like) == 1:
        return like[0]
    if f"{v}_{tag}" in like:
        return f"{v}_{tag}"
    if like:
        raise KeyError(f"several variables of the climatology match {v!r}, name one by climatology_how_tag: {like}")
    raise ValueError(f"no variable of the climatology matches {v!r}")


def _difference(cube: Cube, climatology: Cube, on: list[str], pairs: dict[str, str], relative: bool) -> Cube:
    """Each variable less its climatology; relative: in percent of it, missing where it is zero.
    Cells without a climatology are missing."""
    other = climatology.df.select(*on, *[F.col(c).alias(f"__c_{v}") for v, c in pairs.items()])
    joined = cube.df.join(other, on, "left") if on else cube.df.crossJoin(F.broadcast(other))  # one row
    made = {}
    for v in cube.vars:
        less = F.col(v) - F.col(f"__c_{v}")
        made[v] = F.try_divide(less, F.col(f"__c_{v}")) * 100 if relative else less
    return cube.with_df(joined.select(*cube.dims, *cube.coords, *[made[v].alias(v, metadata=cube.meta(v)) for v in cube.vars]))


def anomaly(cube: Cube, climatology: Cube, *, frequency: str | None = None, bin_widths=None, time_dim: str | None = None, relative: bool = False, climatology_how_tag: str = "", how_label: str | None = None, how: st.How = "mean") -> Cube:
    """Deviation from a climatology.

    The climatology's component dimension (or bins of one) says what to match by; without one it
    is subtracted as it is. ``frequency``: 'year' resamples before the subtraction, others after;
    'climatology' means the climatology's own. Column attributes name the anomaly."""
    t = time_axis(cube, time_dim)
    if "year" in climatology.dims:
        raise ValueError("a climatology with a year dimension has no single value to subtract")
    binned = next((d for d in climatology.dims if d.endswith("_bins")), None)
    own = binned or next((d for d in CLIMATOLOGY_DIMS if d in climatology.dims), None)
    if bin_widths is not None and binned is None:
        raise ValueError("bin_widths need a climatology of bins")
    pairs = {v: _matched(v, climatology, climatology_how_tag) for v in cube.vars}
    if frequency == "climatology":
        frequency = own or "year"
    if frequency == "year":
        cube = temporal.reduce(cube, how, frequency="YE", time_dim=t)
    work, on = cube, [d for d in climatology.dims if d in cube.dims]
    if own:
        value = component(own.removesuffix("_bins"), F.col(t))[1]
        if binned:
            if bin_widths is None:
                raise ValueError("give the bin_widths that the climatology was made with")
            value = bins(own.removesuffix("_bins"), value, bin_widths)
        work, on = cube.with_df(cube.df.withColumn(own, value)), [*on, own]
    if lost := [d for d in climatology.dims if d not in on]:
        raise ValueError(f"dimensions of the climatology that the data lacks: {lost}")
    out = _difference(work, climatology, on, pairs, relative)
    if frequency not in (None, "year"):
        out = temporal.reduce(out, how, frequency=frequency, time_dim=t)
    return _named(out, how_label, relative)


def _named(cube: Cube, how_label: str | None, relative: bool) -> Cube:
    kind = "relative_anomaly" if relative else "anomaly"
    columns = []
    for v in cube.vars:
        meta = cube.meta(v)
        if "standard_name" in meta:
            meta["standard_name"] += f"_{kind}"
        if "long_name" in meta:
            meta["long_name"] += f" {kind.replace('_', ' ')}"
        if relative:
            meta["units"] = "%"
        columns.append(F.col(v).alias(labelled(v, how_label), metadata=meta))
    return cube.with_df(cube.df.select(*cube.dims, *cube.coords, *columns), vars=tuple(labelled(v, how_label) for v in cube.vars))


def relative_anomaly(cube: Cube, climatology: Cube, **options) -> Cube:
    return anomaly(cube, climatology, **{**options, "relative": True})


def auto_anomaly(cube: Cube, *, climatology_frequency: str | None = None, climatology_how: st.How = "mean", climatology_range=None, bin_widths=None, time_dim: str | None = None, **options) -> Cube:
    """Deviation from the cube's own climatology, of all of it or of a range of years."""
    own = reduce(cube, climatology_how, frequency=climatology_frequency, bin_widths=bin_widths, time_dim=time_dim, climatology_range=climatology_range)
    return anomaly(cube, own, time_dim=time_dim, bin_widths=bin_widths, **options)


def ordered_by(cube: Cube, name) -> Cube:
    """Sorted by dimensions, seasons from winter on."""
    keys = [season_order(F.col(n)) if n == "season" else F.col(n) for n in names(name)]
    return cube.with_df(cube.df.orderBy(*keys))
