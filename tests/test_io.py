"""Readers, writers and the streaming form."""

import json

from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.sources import from_csv, from_parquet, from_wide, geojson, to_array_rows, to_parquet
from gridloom.streaming import resample_stream


def test_parquet_round_trip(spark, tmp_path):
    cube = Cube.of(spark.createDataFrame([(1, 2.0), (2, float("nan"))], "x int, v double").withMetadata("v", {"units": "m"}), "x")
    to_parquet(cube, str(tmp_path / "c"))
    back = from_parquet(spark, str(tmp_path / "c"), "x")
    assert back.meta("v") == {"units": "m"} and sorted(map(tuple, back.df.collect())) == [(1, 2.0), (2, None)]


def test_csv_and_wide(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,v\n1,2.5\n2,\n")
    assert from_csv(spark, str(tmp_path / "a.csv"), "x int, v double", "x").df.count() == 2
    wide = spark.createDataFrame([("p", 1.0, 2.0)], "id string, y2000 double, y2001 double")
    cube = from_wide(wide, "id", {"y2000": 2000, "y2001": 2001}, "year", "v")
    assert sorted(map(tuple, cube.df.collect())) == [("p", 2000, 1.0), ("p", 2001, 2.0)]
    assert to_array_rows(cube, "year").first()["v"] == [1.0, 2.0]


def test_geojson(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    shapes = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"CODE": "AA"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"CODE": "BB"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
    ]}
    (tmp_path / "f.geojson").write_text(json.dumps(shapes))
    rows = geojson(spark, str(tmp_path / "f.geojson"), "CODE string").orderBy("index").collect()
    assert [r.CODE for r in rows] == ["AA", "BB"] and [len(r.rings) for r in rows] == [1, 2] and rows[0].rings[0][1] == (1.0, 0.0)


def test_stream_resample(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01' + make_dt_interval(0, id) ts, 'a' k, double(id) v from range(48)").write.parquet(src)
    stream = resample_stream(spark.readStream.schema("ts timestamp, k string, v double").parquet(src), "D", {"v": "mean"}, time="ts", keys="k", values="v", watermark="0 seconds")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.v for r in spark.table("daily").orderBy("ts").collect()] == [11.5, 35.5]
    assert spark.table("daily").filter(F.col("k") == "a").count() == 2


def test_shared_folder(spark):
    from gridloom.shared import clean_up, shared_dir, written

    rows = written(spark.range(5).toDF("n"), "numbers")
    assert rows.count() == 5 and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert clean_up(spark) and not clean_up(spark)
