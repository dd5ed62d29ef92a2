"""Series of a stream in order: differences and rolling windows along time, with state for each key.

Rows are held until the watermark has passed them, so that rows which come out of order, but not too
late, take their place; then they are given out in order. A key's state holds the rows still waiting and the last few
given out, no more; keys that have been idle long enough lose theirs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

_STATE = "waiting_t array<long>, waiting_v array<array<double>>, given_t array<long>, given_v array<array<double>>"
Step = Callable[[np.ndarray, int], np.ndarray]


def ordered_series(rows: DataFrame, step: Step, history: int, *, time: str, keys, values, watermark: str, idle: str | None = None) -> DataFrame:
    """What ``step`` makes of each row of a key's series. It gets the cells of the last ``history`` rows
    given out and of the rows now due, in order of time (rows by values, missing ones NaN), and how many of them are
    history; it returns the due rows' results. Of rows of one key and time the last to come counts. idle:
    how long after its last row a key is forgotten, as an interval; None: never."""
    keys, values = ((x,) if isinstance(x, str) else tuple(x) for x in (keys, values))
    forget = pd.Timedelta(idle).value // 1_000_000 if idle else None

    def run(key, frames, state: GroupState):
        waiting_t, waiting_v, given_t, given_v = ([list(x) for x in state.get] if state.exists else [[], [], [], []])
        for frame in frames:
            waiting_t += (frame[time].astype("datetime64[us]").astype("int64")).tolist()
            waiting_v += frame[list(values)].to_numpy(float).tolist()
        line = state.getCurrentWatermarkMs()
        waiting = dict(zip(waiting_t, waiting_v, strict=True))
        done = given_t[-1] if given_t else None
        due = sorted(t for t in waiting if t < line * 1000 and (done is None or t > done))
        if due:
            cells = np.array([*given_v, *(waiting[t] for t in due)], float).reshape(len(given_v) + len(due), len(values))
            found = step(cells, len(given_v))
            out = pd.DataFrame({k: [v] * len(due) for k, v in zip(keys, key, strict=True)})
            out[time] = pd.to_datetime(due, unit="us")
            for i, v in enumerate(values):
                out[v] = found[:, i]
            given_t, given_v = [*given_t, *due][-max(1, history) :], cells[-max(1, history) :].tolist()
            yield out
        left = sorted(t for t in waiting if t >= line * 1000)
        if not left and state.hasTimedOut and forget is not None and given_t and given_t[-1] // 1000 + forget <= line:
            state.remove()
            return
        state.update((left, [waiting[t] for t in left], given_t, given_v))
        if left:
            state.setTimeoutTimestamp(max(line + 1, left[0] // 1000 + 1))
        elif forget is not None:
            state.setTimeoutTimestamp(max(line + 1, given_t[-1] // 1000 + forget))

    kinds = {f.name: f.dataType for f in rows.schema}
    out = StructType([StructField(c, kinds[c]) for c in (*keys, time)])
    for v in values:
        out.add(v, "double")
    clean = rows.select(*keys, time, *[F.col(v).cast("double").alias(v) for v in values]).withWatermark(time, watermark)
    return clean.groupBy(*keys).applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def deaccumulate_stream(rows: DataFrame, *, time: str, keys, values, watermark: str = "1 hour", from_first_step: bool = False, idle: str | None = None) -> DataFrame:
    """Per-step values of accumulated ones: each row less the key's row before. The first row of a key is missing,
    or itself if ``from_first_step``."""

    def step(cells: np.ndarray, known: int) -> np.ndarray:
        first = np.zeros_like(cells[:1]) if from_first_step else np.full_like(cells[:1], np.nan)
        return cells - np.concatenate([first, cells[:-1]]) if not known else np.diff(cells, axis=0)[known - 1 :]

    return ordered_series(rows, step, 1, time=time, keys=keys, values=values, watermark=watermark, idle=idle)


_ROLLING = {"mean": np.nanmean, "sum": np.nansum, "min": np.nanmin, "max": np.nanmax, "std": np.nanstd, "median": np.nanmedian}


def rolling_stream(rows: DataFrame, window: int, how: str = "mean", *, time: str, keys, values, watermark: str = "1 hour", min_periods: int | None = None, idle: str | None = None) -> DataFrame:
    """A statistic over the last ``window`` rows of a key; missing where fewer than ``min_periods`` (by
    default all) are valid."""
    if how not in _ROLLING:
        raise ValueError(f"no rolling {how!r} of a stream")
    least = window if min_periods is None else min_periods

    def step(cells: np.ndarray, known: int) -> np.ndarray:
        padded = np.concatenate([np.full((window - 1, cells.shape[1]), np.nan), cells])
        frames = np.lib.stride_tricks.sliding_window_view(padded, window, axis=0)[known:]
        enough = (~np.isnan(frames)).sum(-1) >= max(least, 1)
        out = np.full(frames.shape[:2], np.nan)
        out[enough] = _ROLLING[how](frames[enough], axis=-1)
        return out

    return ordered_series(rows, step, window - 1, time=time, keys=keys, values=values, watermark=watermark, idle=idle)
