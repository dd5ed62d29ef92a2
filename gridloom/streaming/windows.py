"""Structured Streaming form of resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions.periods import Period

_SPARK_UNITS = {"D": "days", "h": "hours", "min": "minutes", "s": "seconds"}


def resample_stream(events: DataFrame, frequency: str, how: st.How | dict[str, st.How] = "mean", *, time: str, keys=(), values, watermark: str = "1 hour") -> DataFrame:
    """Statistics over tumbling windows of a stream (or table), labelled by their start.

    Windows of n units count from the Unix epoch, as a stream has no first label to count from.
    Events later than the watermark are dropped by Spark; state is kept per open window only."""
    period = Period.parse(frequency)
    if period.code not in _SPARK_UNITS:
        raise ValueError(f"a stream is resampled by days, hours, minutes or seconds, not {frequency!r}")
    named = (values,) if isinstance(values, str) else tuple(values)
    clean = events.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in named}) if named else events
    bucket = F.window(time, f"{period.n} {_SPARK_UNITS[period.code]}")
    chosen = how if isinstance(how, dict) else dict.fromkeys(named, how)
    grouped = clean.withWatermark(time, watermark).groupBy(bucket, *((keys,) if isinstance(keys, str) else keys))
    out = grouped.agg(*[st.aggregate(h, F.col(v)).alias(v) for v, h in chosen.items()])
    return out.select(F.col("window.start").alias(time), *[c for c in out.columns if c != "window"])
