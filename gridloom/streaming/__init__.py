"""Resampling and series of unbounded input."""

from .series import deaccumulate_stream, ordered_series, rolling_stream
from .windows import resample_stream

__all__ = ["deaccumulate_stream", "ordered_series", "resample_stream", "rolling_stream"]
