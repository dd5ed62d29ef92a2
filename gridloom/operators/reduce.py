"""Reductions over dimensions, resampling to calendar periods and rolling windows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cube import Cube, aggregated, labelled, names
from ..detect import find_axis, time_axis
from ..functions import statistics as st
from ..functions.periods import Period, with_origin
from ..functions.selection import exact_quantiles
from .partial import Partial, partial_reduce


def _weighted_frame(cube: Cube, weights, lat: str | None) -> tuple[Cube, Column]:
    """The cube with a weight at each cell: 'latitude', a column name, or a frame of weights with
    one value column, joined on the dimensions it shares with the cube."""
    if isinstance(weights, str):
        if weights in ("latitude", "lat"):
            key = lat or find_axis(cube, "y", coords=True)
            if key is None:
                raise KeyError("latitude weights need a latitude column")
            return cube, st.latitude_weight(F.col(key))
        if weights in cube.df.columns:
            return cube, F.col(weights)
        raise NotImplementedError(f"no standard weights {weights!r}")
    if isinstance(weights, DataFrame):
        shared = [c for c in weights.columns if c in cube.dims]
        (value,) = [c for c in weights.columns if c not in shared]
        other = weights.select(*shared, F.col(value).alias("__weight"))
        if not shared and other.limit(2).count() > 1:
            raise ValueError(f"weights of several rows share no dimension with {cube.dims}")
        return cube.with_df(cube.df.join(other, shared, "left") if shared else cube.df.crossJoin(F.broadcast(other))), F.col("__weight")  # one row
    raise TypeError("weights are a name or a frame")


def reduce(cube: Cube, how: st.How = "mean", *, dim=None, weights=None, lat: str | None = None, how_label: str | None = None, how_dropna: str | None = None, skip_missing: bool = True, **options) -> Cube:
    """Reduce over ``dim`` (all dimensions by default), all variables in one pass. argmin and argmax
    give positions along the one dimension reduced, idxmin and idxmax its labels; cumsum and
    cumprod keep it."""
    named = not callable(how) and not isinstance(how, Partial)
    if weights is None and named and st.resolve(how) in st.CUMULATIVE:
        return _cumulative(cube, st.resolve(how), dim, how_label, **options)
    if weights is None and named and st.resolve(how) in st.POSITIONS:
        return drop_missing(_positions(cube, st.resolve(how), dim, how_label, **options), cube.without(*names(dim)), how_dropna)
    over = cube.dims if dim is None else names(dim)
    if unknown := [d for d in over if d not in cube.dims]:
        raise ValueError(f"not dimensions: {unknown}")
    keys = cube.without(*over)
    out = {v: labelled(v, how_label) for v in cube.vars}
    order = F.col(over[0]) if len(over) == 1 else None
    result = grouped(cube, keys, how, out, order=order, weights=weights, lat=lat, skip_missing=skip_missing, **options)
    return drop_missing(result, keys, how_dropna)


def grouped(cube: Cube, keys, how: st.How, out: dict[str, str], *, order: Column | None = None, weights=None, lat: str | None = None, skip_missing: bool = True, large_groups: bool = False, **options) -> Cube:
    """A statistic of each group of cells of the same ``keys``, which are the dimensions of the result;
    out names the result of each variable. All reductions come here.

    A Partial is merged from states of its tasks. Weighted deviations take the groups' means first; weighted quantiles are selected exactly, and
    so are plain ones if ``large_groups``, where a group's values needn't fit one task."""
    keys = tuple(keys)
    if isinstance(how, Partial):
        if weights is not None or options:
            raise TypeError("a Partial takes neither weights nor options")
        return partial_reduce(cube, keys, how, out)
    if weights is None:
        name = st.resolve(how)
        if large_groups and name in QUANTILES:
            if not (skip_missing and st.checked_options(name, options)[1]):
                raise TypeError("selected quantiles skip missing cells")
            return selected(cube, keys, out, [_level(name, options)], None)
        exprs = {out[v]: st.aggregate(how, F.col(v), order=order, skip_missing=skip_missing, **options) for v in cube.vars}
        return aggregated(cube, list(keys), keys, exprs, {out[v]: v for v in cube.vars})
    name = st.weighted_name(how)
    framed, w = _weighted_frame(cube, weights, lat)
    if name in QUANTILES:
        if not st.checked_options(name, options)[1]:
            raise TypeError("weighted statistics skip missing cells")
        return selected(framed, keys, out, [_level(name, options)], w)
    centres: dict[str, Column | None] = dict.fromkeys(cube.vars)
    if name in st.ABOUT_MEAN:
        means = framed.df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*[st.weighted_mean(F.col(v), w).alias(f"__m_{v}") for v in cube.vars])
        if keys:
            same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
            framed = framed.with_df(framed.df.join(means, same, "left"))  # a row per group, not per cell
        else:
            framed = framed.with_df(framed.df.crossJoin(F.broadcast(means)))  # one row
        centres = {v: F.col(f"__m_{v}") for v in cube.vars}
    exprs = {out[v]: st.weighted(how, F.col(v), w, centres[v], **options) for v in cube.vars}
    return aggregated(framed, list(keys), keys, exprs, {out[v]: v for v in cube.vars})


QUANTILES = ("median", "quantile", "percentile")


def _level(name: str, options: dict) -> float:
    return 0.5 if name == "median" else st.quantile_level(name, options)


def selected(cube: Cube, keys: tuple[str, ...], out: dict[str, str], levels, weight: Column | None) -> Cube:
    """Exact quantiles of groups of any size; of several levels an array."""
    frames = [exact_quantiles(cube.df, keys, F.col(v), levels, "__q", weight).withColumn(out[v], F.col("__q") if len(levels) > 1 else F.get("__q", F.lit(0))).drop("__q") for v in cube.vars]
    df = frames[0]
    for other, v in zip(frames[1:], list(cube.vars)[1:], strict=True):
        renamed = other.select(*[F.col(k).alias(f"__k_{k}") for k in keys], out[v])
        same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        df = df.join(renamed, same).drop(*[f"__k_{k}" for k in keys]) if keys else df.crossJoin(F.broadcast(renamed))  # one row
    for v in cube.vars:
        if kept := cube.meta(v):
            df = df.withMetadata(out[v], kept)
    return replace(cube, df=df.select(*keys, *out.values()), dims=keys, vars=tuple(out.values()), coords=())


def _only(cube: Cube, dim, how: str) -> str:
    over = names(dim) or cube.dims
    if len(over) != 1 or over[0] not in cube.dims:
        raise ValueError(f"{how!r} goes along one dimension of {cube.dims}, not {over}")
    return over[0]


def _cumulative(cube: Cube, how: str, dim, how_label: str | None, **options) -> Cube:
    """Running sums or products along a dimension; missing cells count as nothing. They run within pieces of the
    axis, and go on from the totals of the pieces before, of which there are few."""
    d = _only(cube, dim, how)
    st.checked_options(how, options)
    others = list(cube.without(d))
    f, neutral = (F.sum, 0.0) if how == "cumsum" else (F.product, 1.0)
    numbered = dense_index(cube.df, d).select(d, F.floor(F.col("__index") / PIECE).alias("__piece"))
    df = cube.df.join(numbered, d).withColumns({f"__x_{v}": F.coalesce(F.col(v).cast("double"), F.lit(neutral)) for v in cube.vars})
    totals = df.groupBy(*others, "__piece").agg(*[f(f"__x_{v}").alias(f"__t_{v}") for v in cube.vars])
    ahead = Window.partitionBy(*others).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k_{k}") for k in (*others, "__piece")], *[F.coalesce(f(f"__t_{v}").over(ahead), F.lit(neutral)).alias(f"__b_{v}") for v in cube.vars])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*others, "__piece")]
    along = Window.partitionBy(*others, "__piece").orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
    columns = []
    for v in cube.vars:
        own, earlier = f(f"__x_{v}").over(along), F.col(f"__b_{v}")
        columns.append((own + earlier if how == "cumsum" else own * earlier).alias(labelled(v, how_label), metadata=cube.meta(v)))
    return cube.with_df(df.join(before, same).select(*cube.dims, *cube.coords, *columns), vars=tuple(labelled(v, how_label) for v in cube.vars))


def _positions(cube: Cube, how: str, dim, how_label: str | None, **options) -> Cube:
    """Where along a dimension the extreme lies, from 0."""
    d = _only(cube, dim, how)
    at = reduce(cube, st.POSITIONS[how], dim=d, how_label=how_label, **options)
    df = at.df
    for v in at.vars:
        places = dense_index(cube.df, d).select(F.col(d).alias(v), F.col("__index").cast("long").alias(f"__at_{v}"))
        df = df.join(places, v, "left").drop(v).withColumnRenamed(f"__at_{v}", v)
    return at.with_df(df.select(*at.dims, *at.vars))


def squeeze(cube: Cube, *dims: str, keep=()) -> Cube:
    """Without the dimensions that have one label, but for those to keep; or without ``dims``, of
    which each must have one. One aggregate tells."""
    asked = dims or cube.without(*keep)
    sizes = cube.df.agg(*[F.count_distinct(F.col(d)).alias(d) for d in asked]).first().asDict() if asked else {}
    if several := [d for d in dims if sizes[d] != 1]:
        raise ValueError(f"dimensions of several labels: {several}")
    gone = [d for d in asked if sizes[d] == 1]
    return cube.with_df(cube.df.drop(*gone), dims=cube.without(*gone))


def drop_missing(cube: Cube, dims, how: str | None) -> Cube:
    """Without the labels of ``dims`` that have any or only missing cells, one dimension after the
    other. An absent row counts as a missing cell."""
    if how in (None, "None", "none"):
        return cube
    if how not in ("any", "all"):
        raise ValueError(f"how_dropna is 'any', 'all' or None, not {how!r}")
    for d in names(dims):
        others = cube.without(d)
        valid = F.col(cube.vars[0]).isNotNull()
        for v in cube.vars[1:]:
            valid = (valid & F.col(v).isNotNull()) if how == "any" else (valid | F.col(v).isNotNull())
        per = cube.df.groupBy(d).agg(F.count(F.when(valid, 1)).alias("__n"))
        if how == "any":
            size = F.lit(1).cast("long")
            sizes = cube.df.agg(*[F.count_distinct(F.col(o)).alias(f"__{o}") for o in others]) if others else None
            for o in others:
                size = size * F.col(f"__{o}")
            per = (per.crossJoin(F.broadcast(sizes)) if sizes is not None else per).filter(F.col("__n") == size)
        else:
            per = per.filter("__n > 0")
        cube = cube.with_df(cube.df.join(per.select(d), d, "left_semi").select(*cube.df.columns))
    return cube


def resample(cube: Cube, frequency: str, how: st.How = "mean", *, time_dim: str | None = None, dim: str | None = None, extra_reduce_dims=None, how_label: str | None = None, skip_missing: bool = True, weights=None, fill_gaps: bool = False, **options) -> Cube:
    """Aggregate over calendar periods. ``extra_reduce_dims`` go in the same aggregate. Periods
    without data give no row, or a missing one if ``fill_gaps``."""
    t = time_dim or dim or time_axis(cube)
    period = Period.parse(frequency)
    df, origin = with_origin(cube.df, t, period)
    bucketed = cube.with_df(df.withColumn("__time", F.col(t)).withColumn(t, period.label(F.col(t), origin)).drop("__origin"))
    extra = names(extra_reduce_dims)
    keys = cube.without(*extra)
    out = {v: labelled(v, how_label) for v in cube.vars}
    result = grouped(replace(bucketed, coords=()), keys, how, out, order=F.col("__time"), weights=weights, skip_missing=skip_missing, **options)
    return _filled(result, t, period) if fill_gaps else result


def _filled(cube: Cube, t: str, period: Period) -> Cube:
    """With a row for every period between the first and the last, for all other labels."""
    others = cube.without(t)
    ends = cube.df.agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    labels = ends.select(F.explode(period.sequence(F.col("__lo"), F.col("__hi"))).alias(t))
    frame = labels if not others else cube.df.select(*others).distinct().crossJoin(F.broadcast(labels))
    return cube.with_df(frame.join(cube.df, list(cube.dims), "left").select(*cube.df.columns))


#: Intervals of an axis that its labels are numbered in, side by side.
INTERVALS = 1024
#: Labels of a piece of an axis along which windows run.
PIECE = 1 << 16


def dense_index(df: DataFrame, dim: str) -> DataFrame:
    """(dim, __index, __previous): distinct labels numbered in order. Windows and differences go by these,
    so that an absent row is a missing cell and not skipped.

    Labels that are numbers or times are numbered within intervals of equal width, and the intervals'
    numbers of labels, a bounded table, are summed up: no task has the whole axis. Text labels are."""
    labels = df.select(dim).distinct()
    kind = df.schema[dim].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        place = F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast(kind), F.col(dim)).cast("double")
    elif kind == "date":
        place = F.datediff(F.col(dim), F.lit("1970-01-01").cast("date")).cast("double")
    elif kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        place = F.col(dim).cast("double")
    else:
        w = Window.orderBy(dim)
        return labels.select(dim, (F.row_number().over(w) - 1).alias("__index"), F.lag(dim).over(w).alias("__previous"))
    ends = labels.agg(F.min(place).alias("__lo"), F.max(place).alias("__hi"))
    part = F.coalesce(F.least(F.floor((place - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * INTERVALS), F.lit(INTERVALS - 1)), F.lit(0))
    part = F.when(F.col("__hi") > F.col("__lo"), part).otherwise(0)
    placed = labels.crossJoin(F.broadcast(ends)).select(dim, part.cast("int").alias("__part"))  # one row
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.max(dim).alias("__last"))
    by_part = Window.orderBy("__part")  # INTERVALS rows at most
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lag("__last").over(by_part).alias("__last"))
    w = Window.partitionBy("__part").orderBy(dim)
    numbered = placed.withColumns({"__row": F.row_number().over(w) - 1, "__lag": F.lag(dim).over(w)}).join(F.broadcast(before), "__part")
    return numbered.select(dim, (F.col("__row") + F.col("__before")).cast("long").alias("__index"), F.coalesce("__lag", "__last").alias("__previous"))


def _pieces(df: DataFrame, index: str, low: int, high: int) -> DataFrame:
    """Rows once for each piece of the axis in which a window from ``low`` to ``high`` labels off needs them, with
    the piece as __piece and whether it is the row's own as __own."""
    first, last = (F.floor((F.col(index) - k) / PIECE) for k in (high, low))
    return df.withColumn("__piece", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__piece") == F.floor(F.col(index) / PIECE))


def rolling_reduce(cube: Cube, how_reduce: st.How = "mean", *, dim: dict[str, int] | None = None, how_dropna: str | None = None, min_periods: int | None = None, center: bool = False, how_label: str | None = None, **windows) -> Cube:
    """A statistic over a moving window of labels along one dimension or several.

    Windows are given as ``x=3`` or ``dim={'x': 3}``; other keywords (q, p) go to the statistic. A
    window with fewer than ``min_periods`` valid cells (by default all of it) gives a missing one."""
    sizes = {**(dim or {}), **{k: v for k, v in windows.items() if k in cube.dims}}
    options = {k: v for k, v in windows.items() if k not in cube.dims}
    if not sizes:
        raise ValueError("no window given")
    least = min_periods if min_periods is not None else 1
    for n in sizes.values():
        least *= n if min_periods is None else 1
    name = st.resolve(how_reduce)
    if len(sizes) > 1 and (name in SEPARABLE or name in st.STRICT and st.resolve(st.STRICT[name]) in SEPARABLE):
        result = _separable(cube, name, sizes, least, center, how_label, options)
        return drop_missing(result, list(sizes), how_dropna)
    df = cube.df
    for d in sizes:
        df = df.join(dense_index(cube.df, d).select(d, F.col("__index").alias(f"__i_{d}")), d)

    def over(df: DataFrame, d: str, columns: dict[str, Callable]) -> DataFrame:
        low, high = _frame(sizes[d], center)
        w = Window.partitionBy(*cube.without(d), "__piece").orderBy(f"__i_{d}").rangeBetween(low, high)
        return _pieces(df, f"__i_{d}", low, high).withColumns({c: f(w) for c, f in columns.items()}).filter("__own").drop("__piece", "__own")

    if len(sizes) == 1:
        ((d, n),) = sizes.items()
        df = over(df, d, {f"__r_{v}": lambda w, v=v: st.over_window(how_reduce, F.col(v), w, least, n, F.col(f"__i_{d}"), _frame(n, center)[0], **options) for v in cube.vars})
        exprs = {v: F.col(f"__r_{v}") for v in cube.vars}
    else:  # collect the cells of the block one dimension after the other
        df = _framed(df, cube, sizes, center).withColumns({f"__c_{v}": F.when(F.col(v).isNotNull(), F.array(F.col(v).cast("double"))).otherwise(F.array().cast("array<double>")) for v in cube.vars})
        for d in sizes:
            df = over(df, d, {f"__c_{v}": lambda w, v=v: F.flatten(F.collect_list(f"__c_{v}").over(w)) for v in cube.vars})
        df = df.filter("__there")
        exprs = {v: F.when(F.size(f"__c_{v}") >= least, _of_array(name, F.col(f"__c_{v}"), math.prod(sizes.values()), options)) for v in cube.vars}
    columns = [*cube.dims, *[e.alias(labelled(v, how_label), metadata=cube.meta(v)) for v, e in exprs.items()]]
    result = replace(cube, df=df.select(*columns), vars=tuple(labelled(v, how_label) for v in cube.vars), coords=())
    return drop_missing(result, list(sizes), how_dropna)


def _frame(n: int, center: bool) -> tuple[int, int]:
    return (-(n // 2), (n - 1) // 2) if center else (-(n - 1), 0)


def _framed(df: DataFrame, cube: Cube, sizes: dict[str, int], center: bool) -> DataFrame:
    """With rows that hold no cell wherever a pass along one dimension leaves something for the next:
    every label that windows of the passes so far reach from a row, within the axis. __there tells the
    cube's own rows."""
    columns = [*cube.dims, *[f"__i_{d}" for d in sizes]]
    df = df.withColumn("__there", F.lit(True))
    reached = df.select(*columns)
    for d in list(sizes)[:-1]:
        low, high = _frame(sizes[d], center)
        axis = dense_index(cube.df, d).select(F.col("__index").alias(f"__i_{d}"), F.col(d))
        rows = reached.drop(d).withColumn(f"__i_{d}", F.explode(F.sequence(F.col(f"__i_{d}") - high, F.col(f"__i_{d}") - low))).distinct()
        reached = rows.join(axis, f"__i_{d}").select(*columns)
    full = reached.join(df.drop(*[d for d in sizes if d not in cube.dims]), columns, "left")
    return full.withColumn("__there", F.coalesce("__there", F.lit(False)))


#: Statistics of blocks that passes along one dimension after the other give, without collecting cells.
SEPARABLE = ("mean", "sum", "count", "min", "max", "std", "var")


def _separable(cube: Cube, name: str, sizes: dict[str, int], least: int, center: bool, how_label: str | None, options: dict) -> Cube:
    """Counts, sums and extrema of blocks, a pass for each dimension. Deviations are sums of squares about
    the variable's mean over the whole cube, a one-row aggregate, for their digits' sake."""
    strict = name in st.STRICT
    name = st.resolve(st.STRICT[name]) if strict else name
    options, skip = st.checked_options(name, options)
    df = cube.df
    if name in ("std", "var"):
        df = df.crossJoin(F.broadcast(df.agg(*[F.avg(F.col(v).cast("double")).alias(f"__m_{v}") for v in cube.vars])))  # one row
    parts = {}
    for v in cube.vars:
        x = F.col(v).cast("double")
        parts[f"__n_{v}"] = (F.when(x.isNotNull(), 1).otherwise(0).cast("long"), F.sum)
        if name in ("mean", "sum"):
            parts[f"__s_{v}"] = (x, F.sum)
        elif name in ("min", "max"):
            parts[f"__s_{v}"] = (F.col(v), getattr(F, name))
        elif name in ("std", "var"):
            parts |= {f"__s_{v}": (x - F.col(f"__m_{v}"), F.sum), f"__q_{v}": ((x - F.col(f"__m_{v}")) ** 2, F.sum)}
    df = df.select(*cube.dims, *[e.alias(c) for c, (e, _) in parts.items()])
    for d in sizes:
        df = df.join(dense_index(cube.df, d).select(d, F.col("__index").alias(f"__i_{d}")), d)
    df = _framed(df, cube, sizes, center)
    for d in sizes:
        low, high = _frame(sizes[d], center)
        w = Window.partitionBy(*cube.without(d), "__piece").orderBy(f"__i_{d}").rangeBetween(low, high)
        df = _pieces(df, f"__i_{d}", low, high).withColumns({c: f(c).over(w) for c, (_, f) in parts.items()}).filter("__own").drop("__piece", "__own")
    if strict or not skip:
        least = math.prod(sizes.values())
    columns = []
    for v in cube.vars:
        n = F.col(f"__n_{v}")
        total = n if name == "count" else F.col(f"__s_{v}")
        if name in ("std", "var"):
            var = F.greatest(F.lit(0.0), F.try_divide(F.col(f"__q_{v}"), n) - F.try_divide(total, n) ** 2)
            out = F.sqrt(var) if name == "std" else var
        else:
            out = F.try_divide(total, n) if name == "mean" else total
        columns.append(F.when(n >= least, out).alias(labelled(v, how_label), metadata=cube.meta(v)))
    return replace(cube, df=df.filter("__there").select(*cube.dims, *columns), vars=tuple(labelled(v, how_label) for v in cube.vars), coords=())


def _of_array(name, cells: Column, size: int, options: dict) -> Column:
    """A statistic of an array of the valid cells of a window of ``size``."""
    strict = name in st.STRICT if not callable(name) else False
    name = st.resolve(st.STRICT[name]) if strict else name
    options, skip = st.checked_options(name, options)
    if callable(name):
        return st.of_cells(name, cells, size, options)
    if strict or not skip:
        return F.when(F.size(cells) == size, _of_array(name, cells, size, options))
    n = F.size(cells)
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    if name in ("median", "quantile", "percentile"):
        level = 0.5 if name == "median" else st.quantile_level(name, options)
        ordered, place = F.array_sort(cells), (n - 1) * level
        low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))
    if name in ("std", "var"):
        mean = F.try_divide(total, n)
        var = F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n)
        return F.sqrt(var) if name == "std" else var
    if name not in ("mean", "sum", "max", "min", "count"):
        raise ValueError(f"no rolling {name!r} over several dimensions")
    return {"mean": F.try_divide(total, n), "sum": total, "max": F.array_max(cells), "min": F.array_min(cells), "count": n}[name]
