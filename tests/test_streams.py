"""Streams that come in several files, out of order and late, against what a batch gives."""

import math
import uuid
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from gridloom.streaming import deaccumulate_stream, resample_stream, rolling_stream

START = datetime(2024, 1, 1)


def files(spark, folder, *parts):
    for part in parts:
        rows = [(START + timedelta(hours=h), k, v) for h, k, v in part]
        spark.createDataFrame(rows, "t timestamp, k string, v double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("t timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, stream, tmp_path):
    out = str(tmp_path / uuid.uuid4().hex)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(((int((r.t - START).total_seconds()) // 3600, r.k, None if r.v is None or math.isnan(r.v) else r.v) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=str)


ORDERLY = [(h, k, float(h * h % 17 + (k == "b"))) for h in range(48) for k in "ab" if (h, k) not in ((7, "a"), (8, "a"))]


def parts():
    """Rows of the first day with two that come later but in time, the second day, rows long past with one far ahead."""
    first = [r for r in ORDERLY if r[0] < 24 and r[:2] not in ((20, "a"), (22, "b"))]
    second = [r for r in ORDERLY if r[0] >= 24 or r[:2] in ((20, "a"), (22, "b"))]
    return first[::-1], second, [(1, "a", 1e9), (2, "c", 1e9), (24 * 365, "z", 0.0)]


def by_key():
    frame = pd.DataFrame(ORDERLY, columns=["h", "k", "v"]).sort_values("h")
    return {k: g for k, g in frame.groupby("k")}


def test_differences(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), *parts())
    got = run(spark, deaccumulate_stream(stream, time="t", keys="k", values="v", watermark="5 hours"), tmp_path)
    want = [(int(h), k, None if math.isnan(d) else d) for k, g in by_key().items() for h, d in zip(g.h, g.v.diff(), strict=True)]
    assert got == sorted(want, key=str)


def test_rolling_mean(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), *parts())
    got = run(spark, rolling_stream(stream, 4, "mean", time="t", keys="k", values="v", watermark="5 hours", min_periods=2), tmp_path)
    want = {(int(h), k): None if math.isnan(m) else m for k, g in by_key().items() for h, m in zip(g.h, g.v.rolling(4, min_periods=2).mean(), strict=True)}
    assert {(h, k) for h, k, _ in got} == set(want) and all(v == (None if want[h, k] is None else pytest.approx(want[h, k])) for h, k, v in got)
    with pytest.raises(ValueError):
        rolling_stream(stream, 4, "mode", time="t", keys="k", values="v")


def test_windows_drop_late_rows(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), *parts())
    got = run(spark, resample_stream(stream, "6h", "sum", time="t", keys="k", values="v", watermark="5 hours"), tmp_path)
    frame = pd.DataFrame(ORDERLY, columns=["h", "k", "v"])
    want = frame.groupby([frame.h // 6 * 6, "k"]).v.sum()
    assert got == sorted(((int(h), k, v) for (h, k), v in want.items()), key=str)


def test_idle_keys_are_forgotten(spark, tmp_path):
    early, late = [(h, "a", float(h)) for h in range(4)], [(h, "a", 100.0 + h) for h in range(500, 503)]
    ticks = [[(h, "clock", 0.0)] for h in (50, 100, 150, 200, 499)]
    stream = files(spark, str(tmp_path / "in"), early, *ticks, late, [(9000, "clock", 0.0)])
    got = run(spark, deaccumulate_stream(stream, time="t", keys="k", values="v", watermark="1 hour", idle="24 hours"), tmp_path)
    assert [(h, v) for h, k, v in sorted(got) if k == "a"] == [(0, None), (1, 1.0), (2, 1.0), (3, 1.0), (500, None), (501, 1.0), (502, 1.0)]


def test_steps_agree_however_rows_are_cut():
    """A step over all rows equals steps over runs of them with their history."""
    taken = {}

    class Rows:
        schema = []

    def capture(rows, step, history, **_):
        taken["step"], taken["history"] = step, history

    from gridloom.streaming import series

    cells = np.random.default_rng(1).normal(size=(30, 2))
    cells[5, 0] = np.nan
    real = series.ordered_series
    try:
        series.ordered_series = capture
        for make in (lambda: series.deaccumulate_stream(None, time="t", keys="k", values="v"), lambda: series.rolling_stream(None, 5, "max", time="t", keys="k", values="v", min_periods=3)):
            make()
            step, m = taken["step"], max(1, taken["history"])
            whole = step(cells, 0)
            for cut in (1, 3, 7, 29):
                known = min(m, cut)
                assert np.allclose(step(cells[cut - known :], known), whole[cut:], equal_nan=True)
    finally:
        series.ordered_series = real
