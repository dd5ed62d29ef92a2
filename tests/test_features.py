"""Features of very different size, and grids drawn line by line, against a plain even-odd test."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.operators import spatial


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def shapes(seed):
    rng = random.Random(seed)
    yield "world", spatial.box(-180, -90, 180, 90)
    yield "holed", [[(-50, -40), (60, -40), (60, 50), (-50, 50)], [(-10, -10), (10, -10), (10, 10), (-10, 10)]]
    yield "nothing", []
    yield "line", [[(0, 0), (5, 5)]]
    yield "flat", [[(0, 20), (30, 20), (50, 20)]]
    yield "on the labels", spatial.box(-20, -20, 20, 20)
    for k in range(25):
        x, y, r = rng.uniform(-170, 170), rng.uniform(-85, 85), 10 ** rng.uniform(-2, 2)
        corners = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 12)))
        yield f"star {k}", [[(x + r * rng.uniform(0.3, 1) * math.cos(a), y + r * rng.uniform(0.3, 1) * math.sin(a)) for a in corners]]


def table(spark, found):
    return spatial.features(spark, list(found), "name")


@pytest.mark.parametrize("step", [10, 7.5])
def test_scanline_and_points_agree_with_the_even_odd_rule(spark, step):
    lats = [-90.0 + step * k for k in range(int(180 / step) + 1)]
    lons = [-180.0 + step * k for k in range(int(360 / step))]
    cells = Cube.of(spark.createDataFrame([(y, x, 1.0) for y in lats for x in lons], "lat double, lon double, v double"), ("lat", "lon"))
    found = list(shapes(1))
    want = {(y, x, n) for n, rings in found for y in lats for x in lons if inside([r for r in rings if len(r) > 2], x, y)}
    drawn = [tuple(r) for r in spatial.cells_by_scanline(cells, table(spark, found), "name", "lat", "lon").collect()]
    looked_up = [tuple(r) for r in spatial.points_in_features(cells, table(spark, found), "name", "lat", "lon").collect()]
    assert sorted(drawn) == sorted(looked_up) == sorted(want) and len(want) > 300


def test_reductions_by_scanline(spark):
    rows = [(float(y), float(x), t, float(y * x + t)) for y in range(-40, 41, 10) for x in range(-60, 61, 10) for t in range(3) if (y + x + t) % 7]
    cube = Cube.of(spark.createDataFrame(rows, "lat double, lon double, t int, v double"), ("lat", "lon", "t"))
    regions = table(spark, shapes(2))
    for run in (
        lambda **o: spatial.reduce(cube, regions, "mean", mask_dim="name", **o),
        lambda **o: spatial.mask(cube, regions, mask_dim="name", **o),
        lambda **o: spatial.mask(cube, regions, union_geometries=True, **o),
        lambda **o: spatial.masks_of(cube, regions, mask_dim="name", **o),
    ):
        assert sorted(map(str, run().df.collect())) == sorted(map(str, run(scanline=True).df.collect()))
    with pytest.raises(ValueError, match="centres"):
        spatial.mask(cube, regions, scanline=True, all_touched=True)
    uneven = cube.with_df(cube.df.withColumn("lat", F.col("lat") ** 3))
    with pytest.raises(Exception, match="evenly spaced"):
        spatial.cells_by_scanline(uneven, regions, "name", "lat", "lon").collect()


def test_a_single_row_and_column(spark):
    for cells in ([(5.0, 5.0)], [(5.0, float(x)) for x in range(4)], [(float(y), 5.0) for y in range(9)]):
        cube = Cube.of(spark.createDataFrame([(*c, 1.0) for c in cells], "lat double, lon double, v double"), ("lat", "lon"))
        regions = table(spark, [("a", spatial.box(1, 1, 8, 7)), ("b", spatial.box(50, 50, 60, 60))])
        assert sorted(map(tuple, spatial.cells_by_scanline(cube, regions, "name", "lat", "lon").collect())) == sorted((y, x, "a") for y, x in cells if 1 <= x < 8 and 1 <= y < 7)


def test_a_world_and_small_boxes_test_few_pairs(spark):
    """Pairs that come to the polygon test, against the hits."""
    boxes = spark.range(20_000).select(F.col("id").cast("string").alias("name"), (F.col("id") % 200 * 1.7 - 170).alias("x"), (F.floor(F.col("id") / 200) * 1.6 - 80).alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    small = boxes.select("name", F.array(F.array(*[corner(dx, dy) for dx, dy in ((0, 0), (1.5, 0), (1.5, 1.5), (0, 1.5))])).alias("rings"))
    regions = small.unionByName(table(spark, [("world", spatial.box(-180, -90, 180, 90))]))
    points = spark.range(20_000).select((F.pmod(F.col("id") * 7919, F.lit(1790)) / 10.0 - 89.5).alias("lat"), (F.pmod(F.col("id") * 104729, F.lit(3590)) / 10.0 - 179.5).alias("lon"), F.lit(1.0).alias("v"))
    cube = Cube.of(points.dropDuplicates(["lat", "lon"]), ("lat", "lon"))
    hits = spatial.points_in_features(cube, regions, "name", "lat", "lon")
    n, whole = hits.count(), cube.df.count()
    assert hits.filter("name = 'world'").count() == whole and n > whole * 1.5
    joined = spatial.pairs_to_test(cube, regions, "name", "lat", "lon").count()
    assert joined <= 3 * n
