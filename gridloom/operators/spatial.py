"""Masks and statistics over features: points or grid cells in polygons.

A feature table has a key, ``rings`` (array of rings, arrays of struct<x, y>) and the columns to
carry along. The even-odd rule over all rings covers holes and several parts. The distinct points
of the cube are matched to features once: they meet on the tiles of a grid, then by bounding box, then
by the polygon; the result, a small table of points and features, is what the data are joined with.
Tiles come in levels, each twice as large as the one below: a feature lies on a few tiles of the level of
its own size, and a point is looked up on every level that has features.

On a grid whose latitudes and longitudes are axes of their own, features can be drawn line by line instead
(``scanline``): the edges that cross a row of the grid, in order, give its runs of cells, at a cost by
rows and edges and not by points.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cube import Cube, labelled, names
from ..detect import find_axis
from ..functions import statistics as st
from . import reduce as core

RINGS = "array<array<struct<x:double,y:double>>>"
#: Tiles are no smaller than this power of two.
LEAST_LEVEL = -20


def features(spark: SparkSession, shapes: list[tuple], *columns: str) -> DataFrame:
    """A feature table of (key..., rings) tuples, rings as lists of (x, y) pairs."""
    rows = [(*s[:-1], [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s[-1]]) for s in shapes]
    kinds = [f"{c} {'long' if isinstance(shapes[0][k], int) else 'string'}" for k, c in enumerate(columns)]
    return spark.createDataFrame(rows, ", ".join([*kinds, f"rings {RINGS}"]))


def box(x0: float, y0: float, x1: float, y1: float) -> list[list[tuple[float, float]]]:
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the rings an odd number of times."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def edge(total: Column, k: Column) -> Column:
            a, b = F.get(ring, k), F.get(ring, (k + 1) % n)
            cuts = (a.y > y) != (b.y > y)
            return total + F.when(cuts & (x < F.try_divide((b.x - a.x) * (y - a.y), b.y - a.y) + a.x), 1).otherwise(0)

        return F.when(n > 2, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), edge)).otherwise(0)

    return F.aggregate(rings, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1


def touches(rings: Column, x: Column, y: Column, half_x: Column, half_y: Column) -> Column:
    """Whether a cell, a box about its centre, shares a point with the polygon: its centre lies
    inside, or an edge passes through it."""

    def cut(a: Column, b: Column) -> Column:
        dx, dy = b.x - a.x, b.y - a.y
        lows, highs, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
        for start, d, c, half in ((a.x, dx, x, half_x), (a.y, dy, y, half_y)):
            t1, t2 = F.try_divide(c - half - start, d), F.try_divide(c + half - start, d)
            lows.append(F.coalesce(F.least(t1, t2), F.lit(0.0)))
            highs.append(F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
            ok = ok & ((d != 0) | ((start >= c - half) & (start <= c + half)))
        return ok & (F.greatest(*lows) <= F.least(*highs))

    passes = F.exists(rings, lambda r: F.exists(F.sequence(F.lit(0), F.size(r) - 1), lambda k: cut(F.get(r, k), F.get(r, (k + 1) % F.size(r)))))
    return inside(rings, x, y) | passes


def _bounded(table: DataFrame) -> DataFrame:
    """With the bounding box, for a cheap first comparison."""
    points = F.flatten("rings")
    ends = {"__x0": F.array_min(F.transform(points, lambda p: p.x)), "__x1": F.array_max(F.transform(points, lambda p: p.x)), "__y0": F.array_min(F.transform(points, lambda p: p.y)), "__y1": F.array_max(F.transform(points, lambda p: p.y))}
    return table.withColumns(ends)


def _axes(cube: Cube, lat: str | None, lon: str | None) -> tuple[str, str]:
    return lat or find_axis(cube, "y", required=True, coords=True), lon or find_axis(cube, "x", required=True, coords=True)


def _half_steps(cube: Cube, column: str, name: str) -> DataFrame:
    """One row: half the smallest step between the column's labels."""
    step = F.col(column) - F.lag(column).over(Window.orderBy(column))
    return cube.df.select(column).distinct().select(step.alias("s")).agg((F.coalesce(F.min("s"), F.lit(0.0)) / 2).alias(name))


def with_key(table: DataFrame, mask_dim: str | dict | None) -> tuple[DataFrame, str]:
    """The feature table and the name of its key: a column of it, a new name for its running
    number, or {name: values} in the order of the ``index`` column."""
    if isinstance(mask_dim, str) and mask_dim in table.columns:
        return table, mask_dim
    if isinstance(mask_dim, dict):
        ((name, values),) = mask_dim.items()
        given = F.get(F.array(*map(F.lit, values)), (F.row_number().over(Window.orderBy("__order")) - 1))
        return table.withColumn("__order", F.monotonically_increasing_id()).withColumn(name, given).drop("__order"), name
    name = mask_dim or "index"
    if name in table.columns:
        return table, name
    order = F.row_number().over(Window.orderBy("__order")) - 1  # features, not cells
    return table.withColumn("__order", F.monotonically_increasing_id()).withColumn(name, order.cast("long")).drop("__order"), name


def pairs_to_test(cube: Cube, table: DataFrame, key: str, lat: str, lon: str, all_touched: bool = False) -> DataFrame:
    """Each distinct point with each feature whose bounding box holds it (or its cell touches)."""
    points = cube.df.select(lat, lon).distinct()
    shapes = _bounded(table.select(key, "rings"))
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    rx = ry = F.lit(0.0)
    if all_touched:
        points = points.crossJoin(F.broadcast(_half_steps(cube, lon, "__rx"))).crossJoin(F.broadcast(_half_steps(cube, lat, "__ry")))  # one row each
        rx, ry = F.col("__rx"), F.col("__ry")
        shapes = shapes.crossJoin(F.broadcast(points.select("__rx", "__ry").limit(1)))
    sides = [F.col(f"__{c}1") - F.col(f"__{c}0") + 2 * r for c, r in (("x", rx), ("y", ry))]
    level = F.greatest(F.ceil(F.log2(F.greatest(*sides))), F.lit(LEAST_LEVEL)).cast("int")
    shapes = shapes.withColumn("__level", F.coalesce(level, F.lit(LEAST_LEVEL)))  # of size 0: no logarithm
    size = F.pow(F.lit(2.0), F.col("__level"))
    for c, r, i in (("x", rx, "__i"), ("y", ry, "__j")):  # two tiles a side at most
        shapes = shapes.withColumn(i, F.explode(F.sequence(F.floor((F.col(f"__{c}0") - r) / size), F.floor((F.col(f"__{c}1") + r) / size))))
    levels = shapes.select("__level").distinct()  # powers of two between the sizes of features: some dozens
    points = points.crossJoin(F.broadcast(levels)).withColumns({"__i": F.floor(x / size), "__j": F.floor(y / size)})
    shapes = shapes.drop("__rx", "__ry")
    near = (x >= F.col("__x0") - rx) & (x <= F.col("__x1") + rx) & (y >= F.col("__y0") - ry) & (y <= F.col("__y1") + ry)
    return points.join(shapes, ["__level", "__i", "__j"]).filter(near)


def points_in_features(cube: Cube, table: DataFrame, key: str, lat: str, lon: str, all_touched: bool = False) -> DataFrame:
    """(lat, lon, key) of each distinct point and each feature it lies in."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    hit = touches(F.col("rings"), x, y, F.col("__rx"), F.col("__ry")) if all_touched else inside(F.col("rings"), x, y)
    return pairs_to_test(cube, table, key, lat, lon, all_touched).filter(hit).select(lat, lon, key)


def _axis_labels(cube: Cube, column: str, name: str) -> DataFrame:
    """One row: the column's labels in order, as an array. Axes are short beside the grid."""
    return cube.df.select(F.col(column).cast("double").alias("a")).distinct().agg(F.array_sort(F.collect_list("a")).alias(name))


def _even(labels: Column) -> Column:
    """Labels as they are, or an error where their steps differ."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.get(labels, i) - F.get(labels, i - 1))
    even = (F.size(labels) < 3) | ((F.array_max(steps) - F.array_min(steps)) <= 1e-5 * F.array_max(steps))
    return F.when(even, labels).otherwise(F.raise_error(F.lit("scanline needs evenly spaced latitudes and longitudes")))


def _first_at_least(labels: Column, value: Column) -> Column:
    """Place of the first of evenly spaced labels that isn't below a value; their number if there is
    none. Worked out from the step, and put right by one where rounding has moved it."""
    n = F.size(labels)
    start, step = F.get(labels, F.lit(0)), F.try_divide(F.get(labels, n - 1) - F.get(labels, F.lit(0)), n - 1)
    guess = F.least(F.greatest(F.coalesce(F.ceil((value - start) / step), F.lit(0)), F.lit(0)), n).cast("int")
    down = F.when((guess > 0) & (F.get(labels, guess - 1) >= value), guess - 1).otherwise(guess)
    return F.when((down < n) & (F.get(labels, down) < value), down + 1).otherwise(down).cast("int")


def cells_by_scanline(cube: Cube, table: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(lat, lon, key) of the grid's cells whose centres lie in each feature, as points_in_features, for axes
    that are evenly spaced (an error where they aren't). Cells that the cube doesn't have are among them."""
    axes = _axis_labels(cube, lat, "__ys").crossJoin(F.broadcast(_axis_labels(cube, lon, "__xs")))  # one row
    axes = axes.withColumns({a: _even(F.col(a)) for a in ("__ys", "__xs")})
    closed = F.transform("rings", lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda k: F.struct(F.get(r, k).alias("a"), F.get(r, (k + 1) % F.size(r)).alias("b"))))
    edges = table.select(key, F.explode(F.flatten(F.filter(closed, lambda r: F.size(r) > 2))).alias("e"))
    edges = edges.select(key, *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]).filter("ay <> by")
    placed = edges.crossJoin(F.broadcast(axes))
    # a row is crossed where one end lies above it and the other doesn't: from the lower end on, below the upper
    first, last = _first_at_least(F.col("__ys"), F.least("ay", "by")), _first_at_least(F.col("__ys"), F.greatest("ay", "by")) - 1
    crossed = placed.withColumn("__r", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    y = F.get("__ys", F.col("__r"))
    cuts = crossed.withColumn("__c", (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    rows = cuts.groupBy(key, "__r").agg(F.array_sort(F.collect_list("__c")).alias("__c")).crossJoin(F.broadcast(axes))  # a feature's crossings of one row
    pairs = F.transform(F.sequence(F.lit(0), F.size("__c") - 2, F.lit(2)), lambda k: F.struct(_first_at_least(F.col("__xs"), F.get("__c", k)).alias("lo"), (_first_at_least(F.col("__xs"), F.get("__c", k + 1)) - 1).alias("hi")))
    runs = rows.withColumn("__run", F.explode(pairs)).filter("__run.lo <= __run.hi")
    cells = runs.select(key, F.get("__ys", F.col("__r")).alias(lat), F.explode(F.transform(F.sequence("__run.lo", "__run.hi"), lambda k: F.get("__xs", k))).alias(lon))
    kinds = {f.name: f.dataType for f in cube.df.schema}
    return cells.select(F.col(lat).cast(kinds[lat]).alias(lat), F.col(lon).cast(kinds[lon]).alias(lon), key)


def _hits(cube: Cube, table: DataFrame, key: str, lat: str, lon: str, all_touched: bool, scanline: bool) -> DataFrame:
    if scanline and all_touched:
        raise ValueError("scanline goes by the centres of cells")
    return cells_by_scanline(cube, table, key, lat, lon) if scanline else points_in_features(cube, table, key, lat, lon, all_touched)


def mask(cube: Cube, table: DataFrame, *, mask_dim: str | dict | None = None, lat: str | None = None, lon: str | None = None, union_geometries: bool = False, all_touched: bool = False, compact: bool = False, scanline: bool = False) -> Cube:
    """Values inside each feature, missing elsewhere, along a new feature dimension; inside any of
    them if ``union_geometries``. ``compact`` leaves the cells outside out instead."""
    lat, lon = _axes(cube, lat, lon)
    table, key = with_key(table, mask_dim)
    hits = _hits(cube, table, key, lat, lon, all_touched, scanline)
    if union_geometries:
        cells = hits.select(lat, lon).distinct()
        if compact:
            return cube.with_df(cube.df.join(cells, [lat, lon], "left_semi").select(*cube.df.columns))
        marked = cube.df.join(cells.withColumn("__in", F.lit(True)), [lat, lon], "left")
        return cube.with_df(marked.select(*cube.dims, *cube.coords, *[F.when(F.col("__in"), F.col(v)).alias(v, metadata=cube.meta(v)) for v in cube.vars]))
    dims = (*cube.dims, key)
    if compact:
        return Cube(cube.df.join(hits, [lat, lon]).select(*dims, *cube.coords, *cube.vars), dims, cube.vars, cube.coords, cube.attrs)
    points = cube.df.select(lat, lon).distinct().crossJoin(table.select(key)).join(hits.withColumn("__in", F.lit(True)), [lat, lon, key], "left")
    whole = cube.df.join(points, [lat, lon])  # the result has a row for each cell and feature
    return Cube(whole.select(*dims, *cube.coords, *[F.when(F.col("__in"), F.col(v)).alias(v, metadata=cube.meta(v)) for v in cube.vars]), dims, cube.vars, cube.coords, cube.attrs)


def masks_of(cube: Cube, table: DataFrame, *, mask_dim: str | dict | None = None, lat: str | None = None, lon: str | None = None, union_geometries: bool = False, all_touched: bool = False, scanline: bool = False) -> Cube:
    """The masks themselves: 1 inside, 0 outside, for each distinct point and feature."""
    lat, lon = _axes(cube, lat, lon)
    points = Cube(cube.df.select(lat, lon).distinct().withColumn("mask", F.lit(1)), (lat, lon), ("mask",))
    out = mask(points, table, mask_dim=mask_dim, lat=lat, lon=lon, union_geometries=union_geometries, all_touched=all_touched, scanline=scanline)
    return out.with_df(out.df.withColumn("mask", F.coalesce("mask", F.lit(0))))


def _mask_table(masks, mask_dim: str | None, shared: tuple[str, ...]) -> tuple[DataFrame, str | None]:
    """Given masks as (shared dims..., key) rows of the cells where they are above zero."""
    several = not isinstance(masks, DataFrame)
    key = mask_dim or ("index" if several else None)
    frames = []
    for k, m in enumerate(masks if several else [masks]):
        (value,) = [c for c in m.columns if c not in shared]
        rows = m.filter((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double"))).select(*[c for c in m.columns if c in shared])
        frames.append(rows.withColumn(key, F.lit(k).cast("long")) if key else rows)
    return fold(DataFrame.unionByName, frames), key


def reduce(cube: Cube, table: DataFrame | None = None, how: st.How = "mean", *, mask_arrays=None, weights=None, lat: str | None = None, lon: str | None = None, extra_reduce_dims=None, mask_dim=None, how_label: str | None = None, all_touched: bool = False, compact: bool = False, expanded: bool = False, squeeze: bool = False, return_geometry_as_coord: bool = False, scanline: bool = False, **options) -> Cube:
    """A statistic over the cells of each feature or mask, or over the whole grid.

    Features and masks without a cell give a missing value (a sum of 0). ``expanded`` carries the
    feature table's columns along (without one: the column ``mask_dim`` or ``index``, 0);
    ``return_geometry_as_coord`` its rings as ``geometry``; ``squeeze`` leaves out what remains of
    dimensions with one label. ``compact`` gives one row per feature with arrays over the
    remaining dimensions, in their order."""
    if table is not None and mask_arrays is not None:
        raise ValueError("give features or masks, not both")
    y, x = lat or find_axis(cube, "y", coords=True), lon or find_axis(cube, "x", coords=True)
    spatial = tuple(d for d in dict.fromkeys((y, x)) if d in cube.dims)
    if not spatial:
        spatial = tuple(d for d in cube.dims if d != find_axis(cube, "t"))
    key, every = None, None
    work = cube
    if table is not None:
        table, key = with_key(table, mask_dim)
        hits = _hits(cube, table, key, *_axes(cube, lat, lon), all_touched, scanline)
        work = Cube(cube.df.join(hits, [y, x]), (*cube.dims, key), cube.vars, cube.coords, cube.attrs)
        every = table.select(key)
    elif mask_arrays is not None:
        shared = (*cube.dims, *cube.coords)
        cells, key = _mask_table(mask_arrays, mask_dim, shared)
        work = Cube(cube.df.join(cells, [c for c in cells.columns if c != key]), (*cube.dims, key) if key else cube.dims, cube.vars, cube.coords, cube.attrs)
        every = cube.df.sparkSession.range(len(mask_arrays) if not isinstance(mask_arrays, DataFrame) else 1).select(F.col("id").alias(key)) if key else None
    over = (*spatial, *names(extra_reduce_dims))
    keys = work.without(*over)
    out = {v: labelled(v, how_label) for v in cube.vars}
    result = core.grouped(work, keys, how, out, weights=weights, lat=lat, **options)
    for v, o in out.items():
        long_name = f"{how if isinstance(how, str) else getattr(how, "__name__", type(how).__name__)} {cube.meta(v).get('long_name', v)}"
        result = result.with_meta(o, long_name=long_name)
    if every is not None:
        result = _all_features(cube, result, every, key, how)
    if squeeze:
        result = core.squeeze(result, keep=(key,))
    if compact and key:
        rest = result.without(key)
        packed = [F.transform(F.array_sort(F.collect_list(F.struct(*rest, F.col(v).alias("__v")))), lambda s: s["__v"]).alias(v) for v in result.vars]
        result = Cube(result.df.groupBy(key).agg(*packed), (key,), result.vars, (), {**result.attrs, "reduced_dims": list(rest)})
    if expanded and table is not None:
        carried = tuple(c for c in table.columns if c != key)
        result = Cube(table.join(result.df, key, "left"), result.dims, result.vars, carried, result.attrs)
    elif expanded and key is None:
        name = mask_dim or "index"
        result = Cube(result.df.withColumn(name, F.lit(0).cast("long")), (*result.dims, name), result.vars, result.coords, result.attrs)
    if return_geometry_as_coord and table is not None:
        result = result.with_df(result.df.join(table.select(key, F.col("rings").alias("geometry")), key, "left"), coords=(*result.coords, "geometry"))
    return result


def _all_features(cube: Cube, result: Cube, every: DataFrame, key: str, how) -> Cube:
    """With a row for each feature and each of the remaining labels."""
    rest = result.without(key)
    frame = every if not rest else every.crossJoin(cube.df.select(*rest).distinct())  # the result's own rows
    empty = F.lit(0) if isinstance(how, str) and st.resolve(how) in ("sum", "count") else F.lit(None)
    joined = frame.join(result.df, list(result.dims), "left")
    return result.with_df(joined.select(*result.dims, *[F.coalesce(F.col(v), empty.cast(result.df.schema[v].dataType)).alias(v, metadata=result.meta(v)) for v in result.vars]))
